"""Mixing sources to target weights by capped water-filling.

Sources by code point (null last) have the weights `weights`, repeating, and
share `share` times all words. A source's target stops at `epochs` times its
size; what that frees is shared among the others by weight until none is
above: in rounds, each one aggregate over the sources, the sources above the
level (words a unit of weight) are clamped and the rest is shared anew. There
may be very many sources: their order is a range-partitioned sort, and no
window or task sees them all.

A source's target is so many whole repetitions of all its documents and a
fraction of one. The fraction takes documents in a seeded order (md5 of the
id and the seed) until its words are reached; the last of them is taken in
part, so a source's words are its target, rounded. Only one of 4096 slices of
that order is ever sorted, the one in which the fraction ends.

Null or empty text: size 0, nothing taken. Null source: a source of its own,
last. Null id: the empty text in the order. Repeated rows share one place in the
order and what is taken there, rounded down. Empty table: empty result. Other
columns are kept by `mix` unless their names are those that it adds, which it
replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import fresh, n_words, table

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"


def place(id_col: Column, seed: str = SEED) -> Column:
    """A document's place in the seeded order: 32 hex digits."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))


def weighted(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """`sizes` with the weight w of each source by its rank among all."""
    part = F.spark_partition_id()
    sorted_ = table(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", part).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # a row for each partition: how many sources the partitions before it have
    before, starts = 0, []
    for r in sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], before % len(weights)))
        before += r["n"]
    rank = F.col("at") + F.element_at(F.create_map(*(F.lit(x) for pair in starts for x in pair)), F.col("part")) if starts else F.col("at")
    return sorted_.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("w"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size)."""
    rows = table(weighted(sizes, weights))
    words, all_w = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    limit, full, gone, level = F.col("source_size") * epochs, 0, 0, None
    while gone < all_w:
        level = (words * share - full * epochs) / (all_w - gone)
        above = F.lit(level) * F.col("w") > limit
        now_full, now_gone = rows.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("w"))), F.lit(0))).first()
        if now_gone == gone:
            break
        full, gone = now_full, now_gone
    top = F.lit(level) if level is not None and gone < all_w else F.lit(float("inf"))
    return rows.select("source", "source_size", F.least(top * F.col("w"), limit.cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target and taken: the words that the mix takes of each row, repeats counted."""
    added = ("size", "source_size", "target", "taken")
    at, th = place(F.col(id_col), seed), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    keys = table(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), at.alias("at"), th.alias("th")))
    slices = keys.groupBy("source", F.substring("at", 1, 3).alias("slice")).agg(F.sum("size").alias("part"))
    slices = table(slices.select("*", F.sum("part").over(Window.partitionBy("source").orderBy("slice")).alias("upto")))  # 4096 rows a source at most
    aims = targets(slices.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, epochs)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = aims.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    s, a = slices.alias("s"), aims.alias("a")
    last = s.join(a, F.col("s.source").eqNullSafe(F.col("a.source"))).groupBy(*(F.col(f"a.{c}") for c in aims.columns))
    reached = F.col("s.upto") >= F.col("a.rest")
    plan = table(last.agg(F.min(F.when(reached, F.struct("s.slice", (F.col("s.upto") - F.col("s.part")).alias("passed")))).alias("end")).select(*aims.columns, "end.slice", "end.passed"))
    # the slice in which the fraction ends, its documents in order; alike rows stand together and share alike
    k, p = keys.alias("k"), plan.alias("p")
    cut = k.join(p, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.substring("k.at", 1, 3) == F.col("p.slice"))).select("k.*", "p.passed", "p.rest")
    cut = cut.groupBy("source", "at", "th").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"), F.first("passed").alias("passed"), F.first("rest").alias("rest"))
    upto = F.sum("all").over(Window.partitionBy("source").orderBy("at", "th").rowsBetween(Window.unboundedPreceding, 0))
    cut = table(cut.select("source", "at", "th", "n", "all", "rest", (F.col("passed") + upto - F.col("all")).alias("passed")))
    cut = cut.select("source", "at", "th", F.floor(F.greatest(F.lit(0), F.least("all", F.col("rest") - F.col("passed"))) / F.col("n")).cast("long").alias("extra"))
    own = [c for c in docs.columns if c not in added]
    d_size, d_at, d_th, p_source, p_size, p_target, p_whole, p_slice = fresh(docs, "__size", "__at", "__th", "__source", "__source_size", "__target", "__whole", "__slice")
    aim = plan.select(F.col("source").alias(p_source), F.col("source_size").alias(p_size), F.col("target").alias(p_target), F.col("whole").alias(p_whole), F.col("slice").alias(p_slice))
    d = docs.select(*own, n_words(F.col(text_col)).alias(d_size), at.alias(d_at), th.alias(d_th))
    d = d.join(aim, F.col(source_col).eqNullSafe(F.col(p_source)))
    there, size, whole = F.substring(d_at, 1, 3), F.col(d_size), F.col(p_whole)
    kept = [*(F.col(c) for c in own), size.alias("size"), F.col(p_size).alias("source_size"), F.col(p_target).alias("target")]
    sure = d.where(there != F.col(p_slice)).select(*kept, (size * (whole + (there < F.col(p_slice)).cast("long"))).alias("taken"))
    c_source, c_at, c_th, c_extra = fresh(d, "__c_source", "__c_at", "__c_th", "__c_extra")
    c = cut.select(F.col("source").alias(c_source), F.col("at").alias(c_at), F.col("th").alias(c_th), F.col("extra").alias(c_extra))
    rest = d.where(there == F.col(p_slice)).join(c, F.col(p_source).eqNullSafe(F.col(c_source)) & (F.col(d_at) == F.col(c_at)) & (F.col(d_th) == F.col(c_th)))
    return sure.unionByName(rest.select(*kept, (size * whole + F.col(c_extra)).alias("taken")))
