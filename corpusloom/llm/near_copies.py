"""Near copies: texts whose five-word shingles have a Jaccard of 0.8 or more, by SimHash and an exact set-similarity join.

Texts with equal shingle sets are one code. SimHash comes first: codes whose
fingerprints (over the same shingles) differ in 2 bits or fewer, found by
multi-index hashing, are compared over their complete sets. A Jaccard of 0.8
leaves about 10 of 64 bits different, so fingerprints alone lose most pairs;
an exact join finds the others.

Shingles have one order for the whole corpus, rarest first. Two sets of
Jaccard t or more share at least t of the larger one, so of n shingles each
has one of the first n - ceil(t * n) + 1 in common with the other (prefix
filter), and sizes differ by a factor of t at most (length filter). No pair is
lost: any order will do for that, so counts of frequent shingles may be rough,
and only serve speed.

What meets in a prefix is compared by bitmaps first: a set has one of 4 to 8
bits a shingle, each shingle toggles one of them. Two sets that differ in d
shingles have bitmaps that differ in d bits at most, and a Jaccard of t needs
d <= (n + m) * (1 - t) / (1 + t) (bitmap filter). What passes is verified over
the complete sets.

Links feed a components search. Where codes meet, bitmaps folded to 256 bits
are compared, so pairs that can't be links aren't written. If the pairs that
meet are more than `crowded` a row of the buckets, there are rounds first: a
code is compared with one code of a bucket, of all its buckets the one it
meets most often; pairs within a component need no comparison any more, and
what is left is compared in full. A round writes and shuffles all rows some ten
times, a pair that meets costs a few machine words: so 64 pairs a row are
compared at once. Results don't depend on that number.

Words as in decontamination; a text of fewer than five words is one shingle.
Shingles and sets are told apart by 64-bit hashes. Nulls and texts without
words are one code. Repeated rows get equal results. An empty table gives an
empty result. Other columns of the input are kept by `keep_one`, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import drop, few, parted, table
from corpusloom.llm.decontaminate import hashes, words
from corpusloom.llm.simhash import BLOCK, components, first_of_each, folded, links

WIDTH, THRESHOLD = 5, 0.8
FREQUENT, LEAST, CROWDED, ROUNDS = 1 << 16, 3, 64, 8
_CHUNK, _ROWS = 1 << 20, 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, in the order of their hashes."""
    tokens = words(text)
    return np.unique(hashes(tokens, min(width, len(tokens)))) if tokens else np.zeros(0, np.uint64)


def frequent(docs: DataFrame, text_col: str, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of about the `most` most frequent shingles."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for text in batch.iloc[:, 0]:
                held.append(shingles(text, width))
                size += len(held[-1])
                if size >= _CHUNK:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"h": keys[n >= LEAST].view(np.int64), "n": n[n >= LEAST]})

    found = docs.select(text_col).mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toPandas()
    keys, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def marks(text: Column, keys: np.ndarray, counts: np.ndarray, width: int, threshold: float) -> Column:
    """struct<code, n, fp, bits, prefix> of a text: a hash of its shingles, their number, SimHash and bitmap, and the first shingles in the order of `counts`."""

    @F.pandas_udf("code long, n int, fp long, bits array<long>, prefix array<long>")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t, width)
                n = len(s)
                m = n - math.ceil(threshold * n - 1e-9) + 1 if n else 0
                often = np.zeros(n, np.int64)
                if len(keys) and n:
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                code = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))
                rows.append((code, n, folded(s[i : i + BLOCK] for i in range(0, n, BLOCK)), bitmap(s), s[np.argsort(often, kind="stable")[:m]].view(np.int64)))
            yield pd.DataFrame(rows, columns=["code", "n", "fp", "bits", "prefix"])

    return mark(text)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A power of two of 64-bit words, 4 bits a shingle or more; of the half size, it is the exclusive or of its halves."""
    bits = 64
    while bits < 4 * len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def plausible(pairs: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of codes that the length filter and the bitmap filter let pass."""
    side = lambda c: near.select(F.col("code").alias(c), F.struct("n", "bits").alias(f"{c}_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    n, m, k = F.col("a_.n"), F.col("b_.n"), F.least(F.size("a_.bits"), F.size("b_.bits"))
    both = both.where(F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9)  # so one bitmap is as long as the other, or twice
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) > k, F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), xor)).otherwise(x)
    apart = F.aggregate(F.zip_with(fold(F.col("a_.bits")), fold(F.col("b_.bits")), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)
    return both.where(apart <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9).select("a", "b")


def folds(bits: Column) -> list[Column]:
    """A bitmap folded to 4 words of 64 bits, with zeros for the words that a smaller one lacks."""

    def word(k: int) -> Column:
        return F.aggregate(F.filter(bits, lambda _, i: i % 4 == k), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)).alias(f"w{k}")

    return [word(k) for k in range(4)]


def near_enough(p: str, q: str, threshold: float) -> Column:
    """The bitmap filter over `folds`, columns of p and q: sets of more than 32 shingles have 4 words or more, all others are compared as one word."""
    apart = [F.col(f"{p}.w{k}").bitwiseXOR(F.col(f"{q}.w{k}")) for k in range(4)]
    most = (F.col(f"{p}.n") + F.col(f"{q}.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    one, four = F.bit_count(reduce(lambda x, y: x.bitwiseXOR(y), apart)), sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    return (one <= most) & ((F.least(F.col(f"{p}.n"), F.col(f"{q}.n")) <= 32) | (four <= most))


def sets_of(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def every(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for i in range(0, len(texts), _ROWS):  # sets are longer than texts
                yield pd.Series([shingles(t, width).view(np.int64) for t in texts.iloc[i : i + _ROWS]], dtype=object)

    return every(text)


def alike(pairs: DataFrame, near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of codes whose sets have a Jaccard of `threshold` or more."""
    both = plausible(pairs, near, threshold).join(sets.select(F.col("code").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("code").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= threshold * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def by_fingerprint(codes: DataFrame) -> DataFrame:
    """The pairs (a, b) that SimHash finds: each code with the first of its fingerprint, and firsts of fingerprints within 2 bits."""
    first = table(few(codes.groupBy("fp").agg(F.min("code").alias("first")), codes.count()))
    same = codes.join(first, "fp").where("code <> first").select(F.col("first").alias("a"), F.col("code").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def linked(members: DataFrame, near: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float, crowded: int = CROWDED, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of all codes that have a link; members: (h, code, n, m) of the codes that meet under a shingle, m of them; pairs: others to compare."""
    fits = (F.least("p.n", "q.n") >= threshold * F.greatest("p.n", "q.n") - 1e-9) & (F.col("p.root") != F.col("q.root"))
    ends = F.least("p.code", "q.code").alias("a"), F.greatest("p.code", "q.code").alias("b")
    roots, loads, by_code, live = None, None, None, members.withColumn("root", F.col("code"))
    for k in range(rounds + 1):
        if by_code is not None:  # roots are joined to codes, not to each of their shingles
            at = by_code.join(roots.select(F.col("node").alias("code"), "root"), "code", "left").select("code", "n", F.coalesce("root", "code").alias("root"), F.explode("hs").alias("h"))
            live = table(at)
            drop(by_code)
            loads = table(loaded(live, k))
            old, live = live, table(live.join(loads.select("h"), "h"))
            drop(old)
            n, meet = loads.agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
            if not n:
                break
        else:  # every code is its own root, so all buckets are live
            n, meet = live.agg(F.count(F.lit(1)), F.sum((F.col("m") - 1) / 2)).first()
        last = k == rounds or not n or meet <= crowded * n
        if last:
            some = live.join(near.select("code", *folds(F.col("bits"))), "code")
            chosen = some.alias("p").join(some.alias("q"), "h").where(fits & (F.col("p.code") < F.col("q.code")) & near_enough("p", "q", threshold)).select(*ends)
        else:  # of the firsts that a code meets, the one it meets most often
            if loads is None:
                loads = table(loaded(live, k))
            met = live.alias("p").join(loads.select("h", "first.*").alias("q"), "h").where(fits).groupBy(F.col("p.code").alias("mine"), F.col("q.code").alias("theirs")).agg(F.count(F.lit(1)).alias("times"))
            best = met.groupBy("mine").agg(F.max_by("theirs", F.struct("times", "theirs")).alias("theirs"))
            chosen = best.select(F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"))
        tried = table((chosen if roots is not None else chosen.unionByName(pairs)).distinct())
        more = table(alike(tried, near, sets, threshold))
        drop(tried, *([] if loads is None else [loads]))
        none = more.isEmpty()
        if not none or roots is None:
            known = more if roots is None else more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))  # a star stands for all its links
            old, roots = roots, table(components(known))
            drop(more, *([] if old is None else [old]))
        if last:
            break
        if none:  # the chosen firsts have no more links: compare all that is left
            crowded = float("inf")
        by_code = table(live.groupBy("code").agg(F.first("n").alias("n"), F.collect_list("h").alias("hs")))
        drop(live, members)
    drop(live)
    return roots


def loaded(live: DataFrame, k: int) -> DataFrame:
    """(h, m, low, high, first) of the buckets in which codes of different roots meet; first: one code, another one each round."""
    return live.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("code", "n", "root"), F.struct(F.xxhash64("code", F.lit(k)), "code")).alias("first")).where("low <> high")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(__id, __th, __to) for every row: id, hash of the text, and its component, a code."""
    keys, counts = frequent(docs, text_col, width)
    every = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), marks(F.col(text_col), keys, counts, width, threshold).alias("m"))
    every = table(every.select("__id", "__th", "m.*"))
    codes = table(every.groupBy("code").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"), F.min("__th").alias("__th")))
    marked = table(every.select("__id", "__th", "code"))
    drop(every)
    rows = codes.select(F.explode("prefix").alias("h"), "code", "n")
    size = codes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = table(few(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), size))
    members = table(few(rows.join(shared, "h"), size))
    near = table(codes.join(members.select("code").distinct(), "code", "left_semi").select("code", "n", "fp", "bits", "__th"))
    drop(codes, shared)
    _, some = parted(docs.select(F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__th")), (F.col("__th"),), near, (F.col("__th"),))
    texts = some.groupBy("__th").agg(F.first("__text").alias("__text")).join(near.select("__th", "code"), "__th")
    sets = table(texts.select("code", sets_of(F.col("__text"), width).alias("s")))
    roots = linked(members, near, sets, by_fingerprint(near), threshold, crowded)
    drop(members, near, sets)
    return marked.join(roots.withColumnRenamed("node", "code"), "code", "left").select("__id", "__th", F.coalesce("root", "code").alias("__to"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """The rows of `docs` that stay: of each component one row, that of the smallest id."""
    return first_of_each(docs, near_copies(docs, id_col, text_col, width, threshold, crowded), id_col, text_col)
