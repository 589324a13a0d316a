"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits, HIGH and LOW. Two
fingerprints that differ in at most 2 bits agree on HIGH, or differ in at
most one bit of LOW (they can't spend two bits on both). So there are two
tables: one keyed by HIGH, probed exactly, and one keyed by LOW, probed with
the Hamming ball of radius 1 around the segment. In the second, of two codes
that differ in one bit only the one with a 0 there probes, so each match is
fetched once. The complete distance of every match is verified.

Buckets with more than `BUCKET` codes are not paired: there the ball of
the other segment extends the key, so that those who meet under a key are
within the distance by construction, and each is linked to the smallest of
its key. No link is lost and nothing grows with the square of a bucket.

Links feed a components search by alternating large and small stars.

Nulls, empty texts: fingerprint zero, linked like any other. A null id takes
part and never becomes the component's id unless all ids of it are null.
Repeated rows get equal results. An empty table gives an empty result. Other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import LOWER_BYTES, drop, few, fresh, parted, table

SEED = 42
BUCKET = 64
BLOCK = 1 << 16
_LOW = 0xFFFFFFFF


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return folded(
        np.array([digest(joined[s:e], SEED) for s, e in zip(a[i : i + BLOCK], b[i : i + BLOCK], strict=True)], np.uint64)
        for i in range(0, len(a), BLOCK))


def folded(blocks: Iterable[np.ndarray]) -> int:
    """The signed fingerprint of shingle hashes: bits set in over half of them."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return simhash(text)


def links(codes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) for distinct codes `fp`: chains that join all codes at 2 or fewer differing bits; every pair is itself within 2."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW))
    codes = codes.select("fp", high.alias("high"), low.alias("low"))
    # a row for each table a code stands in or probes; bit: -1 stored, else the bit of LOW that the probe sets
    zero_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda j: F.expr("low").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), j)) == 0)
    rows = codes.select(
        "fp", "high", "low",
        F.explode(F.concat(F.array(F.lit(-2)), F.array(F.lit(-1)), zero_bits)).alias("bit"),
    ).select(
        "fp", "high", "low", "bit", (F.col("bit") != -2).alias("by_low"),
        F.when(F.col("bit") == -2, F.col("high")).when(F.col("bit") == -1, F.col("low"))
        .otherwise(F.col("low").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("bit"), F.lit(0))))).alias("key"),
    )
    stored = F.col("bit") < 0
    load = rows.groupBy("by_low", "key").agg(F.count(F.when(stored, 1)).alias("n_stored"), F.count(F.lit(1)).alias("n"))
    load = table(load.where("n_stored > 0 and n > 1"))
    rows = table(rows.join(load, ["by_low", "key"]))
    calm = rows.where(F.col("n") <= bucket)
    hot = rows.where(F.col("n") > bucket)
    a, b = calm.alias("a"), calm.where(stored).alias("b")
    near = (
        a.join(b, ["by_low", "key"])
        .where((F.col("a.fp") != F.col("b.fp")) & (~(F.col("a.bit") < 0) | (F.col("a.fp") < F.col("b.fp"))))
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    # hot, both stored: equal in one segment; who shares a point of the other segment's radius-1 ball is within 2
    other = F.when(F.col("by_low"), F.col("high")).otherwise(F.col("low"))
    ball = F.concat(F.array(other), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: other.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))
    points = hot.where(stored).select("fp", "by_low", "key", F.explode(ball).alias("point"))
    stars = points.groupBy("by_low", "key", "point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    starred = points.join(stars.drop("m"), ["by_low", "key", "point"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    # hot, a probe: it names every code that has the key and at most one other bit of HIGH, and looks it up
    aims = hot.where(~stored).select(F.col("fp").alias("a"), F.explode(ball).alias("point"), "key").select(
        "a", F.call_function("shiftleft", F.col("point"), F.lit(32)).bitwiseOR(F.col("key")).alias("fp"))
    fetched = aims.join(hot.where(stored & F.col("by_low")).select("fp"), "fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(starred).unionByName(fetched).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the smallest node reachable.

    Alternating large-star and small-star rounds until only stars are left; each
    node only ever meets the minimum of its neighbours, found by a partial
    aggregate, so no neighbourhood is gathered. The minima are written before
    they are joined: then a root with very many nodes can be split. Tables are
    written in as many files as their rows fill, as there are four a round.
    """
    edges = table(edges.where("a != b"))
    while True:
        size = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(few(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), size))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = table(few(large, size))
        drop(least)
        least = table(few(large.groupBy("a").agg(F.min("b").alias("m")), size))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        old, edges = edges, table(few(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), size))
        drop(old, large, least)
        # a > b in every edge: with one edge out of each node and none out of a root, roots are the smallest of their components
        end = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
        ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0)))).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if few(ends, size).where("out + into > 1 and out > 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(few(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), size))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: fingerprint and the smallest id that links of 2 or fewer bits reach."""
    marked = table(docs.select(F.col(id_col), fingerprint(F.col(text_col), width).alias("fp")))
    codes = table(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = table(components(links(codes)).withColumnRenamed("node", "fp"))
    named = codes.join(roots, "fp")  # only codes that have a link
    named = table(named)
    named = named.join(table(named.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("fp", "component_id")
    groups = table(codes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(groups, "fp")


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each component, that of the smallest id, null last, then of the smallest text hash.

    found: (__id, __th, __to) for every row: id, hash of the text, component.
    """
    found = table(found)
    n = found.count()
    place = F.struct(F.col("__id").isNull().alias("__no"), "__id", "__th")
    first = table(few(found.groupBy("__to").agg(F.min(place).alias("__first")), n))
    counted = found.groupBy("__to", "__id", "__th").agg(F.count(F.lit(1)).alias("n")).join(first, "__to")
    counted = counted.withColumn("stays", F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__th") == F.col("__first.__th")))
    own, i, t, stays = fresh(docs, "__own", "__id", "__th", "stays")
    odd = table(few(counted.where("n > 1 or not stays").select(F.col("__id").alias(i), F.col("__th").alias(t), F.col("stays").alias(stays)), n))  # rows that go, and rows that are alike
    drop(found, first)
    mine = docs.withColumn(own, F.xxhash64(text_col))
    sure, rest = parted(mine, (F.col(id_col), F.col(own)), odd, (F.col(i), F.col(t)))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(t))
    rest, shared = rest.join(odd, same, "left_anti"), rest.join(odd.where(F.col(stays)), same, "left_semi")
    return sure.unionByName(rest).unionByName(shared.dropDuplicates([id_col, own])).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of `docs` that stay: of each component one row, that of the smallest id."""
    marked = table(docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), fingerprint(F.col(text_col), width).alias("fp")))
    roots = components(links(marked.select("fp").distinct())).withColumnRenamed("node", "fp")
    return first_of_each(docs, marked.join(table(roots), "fp", "left").select("__id", "__th", F.coalesce("root", "fp").alias("__to")), id_col, text_col)
