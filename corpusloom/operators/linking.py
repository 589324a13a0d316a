"""Entity linking: candidates by the rarest tokens, a similarity, a status, bridges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

FLOOR, TOP, DIRECT = 0.25, 15, 0.96


def candidates(mentions: DataFrame, mention: str, text: str, concepts: DataFrame, concept: str, label: str, cap: int = 12_000) -> DataFrame:
    """(mention, concept): concepts that share a mention's two rarest known tokens, or one of them if none has both.

    While more than `cap` concepts hold both, the next rarest tokens narrow the
    set; if that leaves none, it is those that hold one of the two. What is
    left is scored in full, however large.
    """
    own = concepts.select(concept, F.explode(F.array_distinct(T.tokens(F.col(label)))).alias("token"))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    said = mentions.select(mention, F.posexplode(T.tokens(F.col(text))).alias("pos", "token")).join(df, "token")
    order = Window.partitionBy(mention).orderBy("df", "pos")
    said = said.withColumn("nth", F.row_number().over(order)).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy(mention)))
    two = said.where("nth <= 2")
    hits = two.join(own, "token").groupBy(mention, concept).agg(F.count(F.lit(1)).alias("held"), F.first("known").alias("known"))
    need = F.least(F.col("known"), F.lit(2))
    best = hits.groupBy(mention).agg(F.max(F.col("held") >= need).alias("all_held"), F.count(F.when(F.col("held") >= need, 1)).alias("n"))
    found = hits.join(best, mention)
    both = found.where(F.col("held") >= need)
    few = both.where(F.col("n") <= cap).select(mention, concept)
    # depth: how many of a mention's tokens, rarest first and without a gap, a concept holds
    many = both.where(F.col("n") > cap).select(mention, concept, "known")
    more = said.where("nth > 2").join(own, "token").select(mention, concept, "nth")
    held = many.join(more, [mention, concept], "left").groupBy(mention, concept, "known").agg(F.array_sort(F.collect_set("nth")).alias("__nths"))
    held = held.withColumn("depth", F.lit(2) + F.size(F.filter("__nths", lambda n, i: n == i + 3))).drop("__nths")
    sizes = held.groupBy(mention, "known", "depth").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("size", F.sum("m").over(Window.partitionBy(mention).orderBy(F.col("depth").desc())))
    top = sizes.groupBy(mention, "known").agg(F.max(F.when(F.col("size") > cap, F.col("depth"))).alias("last"), F.max("depth").alias("deepest"))
    stop = top.select(mention, F.least(F.col("last") + 1, F.col("known")).alias("stop"), "deepest")
    narrowed = held.join(stop, mention).where(F.col("depth") >= F.col("stop")).select(mention, concept)
    none = stop.where(F.col("deepest") < F.col("stop")).select(mention)
    either = hits.join(best.where(~F.col("all_held")).select(mention).unionByName(none), mention).select(mention, concept)
    return few.unionByName(narrowed).unionByName(either)


def indel(a: str, b: str) -> float:
    """1 - insertions and deletions / both lengths, by the longest common subsequence in bit-parallel form."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - bin(row).count("1")
    return 2 * common / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(np.fromiter((indel((x or "").lower().strip(), (y or "").lower().strip()) for x, y in zip(left, right, strict=True)), float, len(left)))

    return ratio(a, b)


def ranked(pairs: DataFrame, mention: str, concept: str, sim: Column, top: int = TOP, floor: float = FLOOR) -> DataFrame:
    """(mention, concept, sim, rank): the best candidates over the floor."""
    rows = pairs.select(mention, concept, F.round(sim, 4).alias("sim"), sim.alias("__raw")).where(F.col("__raw") > floor).drop("__raw")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(mention).orderBy(F.col("sim").desc(), concept))).where(F.col("rank") <= top)


def statuses(mentions: DataFrame, mention: str, best: DataFrame, concept: str, threshold: float = DIRECT) -> DataFrame:
    """(mention, n_candidates, final, status) for every mention."""
    found = best.groupBy(mention).agg(F.count(F.lit(1)).alias("n_candidates"), F.max_by(F.struct(concept, "sim"), F.struct(-F.col("rank"))).alias("b"))
    rows = mentions.select(mention).join(found, mention, "left")
    direct = (F.col("n_candidates") == 1) | (F.col("b.sim") >= threshold)
    status = F.when(F.col("n_candidates").isNull(), "no_match").when(direct, "direct").otherwise("needs_disambiguation")
    return rows.select(mention, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(direct, F.col(f"b.{concept}")).alias("final"), status.alias("status"))


def bridges(links: DataFrame, names: list[str], entities: DataFrame, entity: str, name: str, keep: list[str]) -> DataFrame:
    """Distinct (keep, entity): entities whose normalised name is any of a link's names."""
    key = lambda c: F.lower(T.squeeze(T.filled(F.col(c))))
    left = links.select(*keep, F.explode(F.array_distinct(F.array(*map(key, names)))).alias("__key")).where("__key <> ''")
    return left.join(entities.select(entity, key(name).alias("__key")), "__key").select(*keep, entity).distinct()


def rates(found: DataFrame) -> DataFrame:
    """(status, n, rate): how many mentions have each status, and their share, rounded to 4."""
    counts = found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))  # one row


def link(mentions: DataFrame, mention: str, text: str, concepts: DataFrame, concept: str, label: str, threshold: float = DIRECT, sim=None) -> tuple[DataFrame, DataFrame]:
    """The linking driver: ((mention, concept, sim, rank) of the candidates, (mention, n_candidates, final, status) of every mention).

    `type` and `source_text` of a mention, if it has such columns, are kept by the caller; see `described`.
    """
    pairs = candidates(mentions, mention, text, concepts, concept, label).join(mentions.select(mention, F.col(text).alias("__m")), mention).join(concepts.select(concept, F.col(label).alias("__c")), concept)
    best = ranked(pairs, mention, concept, (sim or similarity)(F.col("__m"), F.col("__c")))
    return best, statuses(mentions, mention, best, concept, threshold)


def described(mentions: DataFrame, kind: str = "type", context: str = "source_text", column: str = "source_column", source: str = "source") -> DataFrame:
    """What a model is told of a mention: its kind, or its column; its surroundings, or the table that it is from."""
    return mentions.withColumn(kind, F.coalesce(kind, column, F.lit(""))).withColumn(context, F.coalesce(F.col(context), F.concat(F.lit("from "), T.filled(F.col(source)))))
