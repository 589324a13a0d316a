r"""LM scoring: prediction by partial matching over bytes, beside a unigram base.

The pretrained model is a trie of byte contexts of up to three bytes, from
all training documents. A symbol is predicted in its longest known context;
escapes are estimated as q / (n + q) from n symbols of q kinds (method C); the
symbols of the longer context are excluded below, down to the uniform
distribution over the bytes that training never saw. A text starts after three
end symbols and ends with one: byte 255, which UTF-8 never uses. The score is
the log10 of the probability of the whole text and its end.

Every context of every training document counts; nothing is pruned. The
probabilities of the `HOT_GRAMS` most frequent four-byte grams (context and
symbol) are broadcast, at most 27 MB in a worker; of all other grams, and of
those that training never saw, a row for each document and gram goes to a join
with their probabilities, which are computed from the complete count tables,
once for each gram. Contexts of one and two bytes are dense tables of at most
65,536 cells. So the model grows with the corpus and memory doesn't.

The base needs the count of every token. The `HOT` most frequent words are
looked up in a broadcast table; of all other words a row for each document and
word goes to a join with the counts. Words are told apart by a 64-bit hash.

Null and empty texts: one token, the end. Null ids: fold of the empty text.
Repeated rows get equal results. No training documents: the uniform model, N
and V 0, so each token of the base is log10(1). Empty table: empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import LOWER_BYTES, drop, fold, table

HOT_GRAMS, HOT, ORDER = 1 << 19, 1 << 17, 3
END = 255
_PIECE = 1 << 20
_END_TOKEN = xxhash.xxh3_64_intdigest(b" ")  # no word has a space


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES)


def _tokens(raw: bytes) -> np.ndarray:
    words = raw.split()
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h[-1] = _END_TOKEN
    return h


def _groups(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about a piece together."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(_raw(text))
        size += len(group[-1])
        if size >= _PIECE or i == len(texts) - 1:
            yield first, group
            first, group, size = i + 1, [], 0


def _grams(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(the text's number, context and symbol as four bytes) of every position, in pieces."""
    pad = bytes([END] * ORDER)
    stream = np.frombuffer(b"".join(pad + r + bytes([END]) for r in raws), np.uint8)
    sizes = np.array([len(r) + 1 for r in raws])
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    for begin in range(0, len(owner), _PIECE):
        end = min(begin + _PIECE, len(owner))
        who = owner[begin:end]
        where = np.arange(begin, end) + (who.astype(np.int64) + 1) * ORDER
        key = np.zeros(end - begin, np.uint32)
        for k in range(ORDER, -1, -1):
            key = (key << np.uint32(8)) | stream[where - k]
        yield who, key


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram boolean, key, n): four-byte grams and word hashes of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.iloc[:, 0].tolist()
            grams, words = [], []
            for _, raws in _groups(texts):
                words.append(np.concatenate([_tokens(r) for r in raws]))
                grams += [np.unique(key, return_counts=True) for _, key in _grams(raws)]
            if not grams:
                continue
            key, where = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in grams])).astype(np.int64)
            yield pd.DataFrame({"gram": True, "key": key.astype(np.int64), "n": n})
            key, n = np.unique(np.concatenate(words), return_counts=True)
            yield pd.DataFrame({"gram": False, "key": key.view(np.int64), "n": n})

    rows = docs.select(text_col).mapInPandas(count, "gram boolean, key bigint, n bigint")
    return rows.groupBy("gram", "key").agg(F.sum("n").alias("n"))


class Lookup:
    """An open-addressing hash table of integers in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.zeros(1 << self.bits, keys.dtype), np.zeros(1 << self.bits, values.dtype)
        self.used = np.zeros(1 << self.bits, bool)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(~self.used[at[todo]])
            _, one = np.unique(at[todo[free]], return_index=True)
            put = todo[free[one]]
            self.keys[at[put]], self.values[at[put]], self.used[at[put]] = keys[put], values[put], True
            left = np.ones(len(todo), bool)
            left[free[one]] = False
            todo = todo[left]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        at = self._home(keys)
        values, found = self.values[at], self.used[at] & (self.keys[at] == keys)
        todo = np.flatnonzero(~found & self.used[at])
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            hit = self.used[at] & (self.keys[at] == keys[todo])
            values[todo[hit]], found[todo[hit]] = self.values[at[hit]], True
            on = ~hit & self.used[at]
            todo, at = todo[on], at[on]
        return values, found


class Low:
    """Log10 probabilities of a byte after one or two known bytes: dense tables from the counts of two-byte grams and the sums of three-byte grams by context."""

    def __init__(self, grams1: tuple, n2: np.ndarray, q2: np.ndarray, gone: np.ndarray):
        """grams1: (two-byte keys, counts); by two-byte context: n, q, and the counts one order below of the symbols known there."""
        one = np.zeros(1 << 16)
        one[np.asarray(grams1[0], np.int64)] = grams1[1]
        square = one.reshape(256, 256)
        seen = square > 0
        self.one, self.zero = one, square.sum(axis=0)
        self.n2, self.q2 = n2, q2
        self.n1x, self.q1x = np.tile(square.sum(axis=1), 256) - gone, np.tile(seen.sum(axis=1).astype(float), 256) - q2
        self.q0 = float((self.zero > 0).sum())
        self.n0x, self.q0x = self.zero.sum() - (seen * self.zero).sum(axis=1), self.q0 - seen.sum(axis=1)

    def log10(self, keys: np.ndarray, c3: np.ndarray, n3: np.ndarray, q3: np.ndarray, gone3: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """For four-byte keys: their counts, and n, q and the counts one order below of the symbols known after three bytes; c2: counts of the last three bytes. Zeros: unknown."""
        p, left = np.ones(len(keys)), np.arange(len(keys))
        two, two_sym, sym = ((keys >> 8) & 0xFFFF), keys & 0xFFFF, keys & 0xFF
        one = two & 0xFF

        def step(n: np.ndarray, q: np.ndarray, count: np.ndarray) -> None:
            nonlocal left
            n, q, count = n[left], q[left], count[left]
            known, total = count > 0, n + q
            p[left] *= np.divide(np.where(known, count, q), total, out=np.ones(len(total)), where=total > 0)
            left = left[~known]

        step(n3, q3, c3)
        step(self.n2[two] - gone3, self.q2[two] - q3, c2)
        step(self.n1x[two], self.q1x[two], self.one[two_sym])
        step(self.n0x[one], self.q0x[one], self.zero[sym])
        p[left] /= max(1.0, 256 - self.q0)
        return np.log10(p)


class Trie:
    """The complete count tables of a trie of three-byte contexts, and the probabilities of its grams."""

    def __init__(self, counted: DataFrame):
        grams = counted.where("gram").select("key", F.col("n").alias("c3"))
        shorter = lambda mask: grams.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("k")).agg(F.sum("c3").alias("c"))
        two = table(shorter(0xFFFFFF))
        ones = table(shorter(0xFFFF).select(F.col("k").alias("k1"), F.col("c").alias("c1")))  # 65,536 rows at most
        low, dense = ones.toPandas(), np.zeros((3, 1 << 16))
        by = two.join(F.broadcast(ones), F.col("k").bitwiseAND(F.lit(0xFFFF)) == F.col("k1"))
        by = by.groupBy(F.shiftright("k", 8).alias("ctx")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("q"), F.sum("c1").alias("gone")).toPandas()  # 65,536 rows at most
        at = by["ctx"].to_numpy(np.int64)
        for row, name in enumerate(("n", "q", "gone")):
            dense[row, at] = by[name].to_numpy(float)
        self.low = Low((low["k1"], low["c1"].to_numpy(float)), *dense)
        self.grams, self.two = grams, two
        below = grams.join(two, F.col("key").bitwiseAND(F.lit(0xFFFFFF)) == F.col("k"))
        self.contexts = table(below.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("c3").alias("n3"), F.count(F.lit(1)).alias("q3"), F.sum("c").alias("gone3")))

    def probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of distinct keys, known or not."""
        low = self.low

        @F.pandas_udf("double")
        def logp(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for key, *counts in batches:
                yield pd.Series(low.log10(key.to_numpy(np.int64), *(c.to_numpy(float) for c in counts)))

        found = keys.join(self.grams, "key", "left")
        found = found.join(self.contexts, F.shiftright("key", 8) == F.col("ctx"), "left")
        found = found.join(self.two, F.col("key").bitwiseAND(F.lit(0xFFFFFF)) == F.col("k"), "left")
        zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return found.select("key", logp("key", *map(zero, ("c3", "n3", "q3", "gone3", "c"))).alias("logp"))

    def hot(self, most: int) -> Lookup:
        """Of the `most` most frequent grams, which bounds what is collected."""
        first = self.probabilities(table(self.grams.orderBy(F.col("c3").desc(), "key").limit(most).select("key"))).toPandas()
        return Lookup(first["key"].to_numpy(np.int64).astype(np.uint32), first["logp"].to_numpy(float))


def scored(text: Column, grams: Lookup, words: Lookup) -> Column:
    """What hot words and grams give to the base and the score, and the hashes and numbers of the others."""

    def others(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.unique(keys, return_counts=True)
        return h, n.astype(np.int32)

    @F.pandas_udf("n_tokens bigint, base double, known bigint, score double, rare_h array<bigint>, rare_n array<int>, cold_h array<bigint>, cold_n array<int>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for _, raws in _groups(texts.tolist()):
                total, cold, owners = np.zeros(len(raws)), [], []
                for who, key in _grams(raws):
                    value, found = grams.find(key)
                    total += np.bincount(who, np.where(found, value, 0), minlength=len(raws))
                    cold.append(key[~found].astype(np.int64))
                    owners.append(who[~found])
                cold, owners = np.concatenate(cold), np.concatenate(owners)
                cut = np.searchsorted(owners, np.arange(len(raws) + 1))
                tokens = [_tokens(r) for r in raws]
                sizes = np.array([len(t) for t in tokens])
                value, found = words.find(np.concatenate(tokens))
                owner = np.repeat(np.arange(len(raws)), sizes)
                base = np.bincount(owner, np.where(found, value, 0), minlength=len(raws))
                known = np.bincount(owner, found, minlength=len(raws))
                ends = np.cumsum(sizes)
                for i, t in enumerate(tokens):
                    rare = others(t[~found[ends[i] - sizes[i] : ends[i]]].view(np.int64))
                    rows.append((int(sizes[i]), base[i], int(known[i]), total[i], *rare, *others(cold[cut[i] : cut[i + 1]])))
            yield pd.DataFrame(rows, columns=["n_tokens", "base", "known", "score", "rare_h", "rare_n", "cold_h", "cold_n"])

    return score(text)


def held_out(id_col: Column) -> Column:
    return fold(id_col, 7) == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_grams: int = HOT_GRAMS, hot_words: int = HOT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learned from those not held out.

    hot_grams, hot_words: sizes of the two broadcast tables; results don't depend on them.
    """
    out = held_out(F.col(id_col))
    counted = table(counts(docs.where(~out), text_col))
    words = counted.where(~F.col("gram")).select(F.col("key").alias("h"), F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    first = words.orderBy(F.col("c").desc(), "h").limit(hot_words).toPandas()
    hot = Lookup(first["h"].to_numpy(np.int64).view(np.uint64), np.log10(first["c"].to_numpy(float) + 1))
    # the least frequent hot word: words that come before it in the order are hot
    edge = (int(first["c"].iloc[-1]), int(first["h"].iloc[-1])) if len(first) else (0, 0)
    trie = Trie(counted)
    key = [F.col(id_col).alias("did"), F.xxhash64(text_col).alias("th")]
    main = table(docs.select(*key, out.alias("held_out"), scored(F.col(text_col), trie.hot(hot_grams), hot).alias("s")).select("did", "th", "held_out", "s.*"))
    cold = table(main.select(F.explode("cold_h").alias("key")).distinct())
    rest = words.where((F.col("c") < edge[0]) | ((F.col("c") == edge[0]) & (F.col("h") > edge[1])))
    values = table(rest.select(F.lit(False).alias("gram"), "h", F.log10(F.col("c") + 1.0).alias("value")).unionByName(
        trie.probabilities(cold).select(F.lit(True).alias("gram"), F.col("key").alias("h"), F.col("logp").alias("value"))))
    drop(cold, trie.two, trie.contexts, counted)
    pairs = lambda h, m, gram: F.transform(F.arrays_zip(h, m), lambda x: F.struct(F.lit(gram).alias("gram"), x[h].alias("h"), x[m].alias("n")))
    one_each = main.select("did", "th", F.explode(F.concat(pairs("rare_h", "rare_n", False), pairs("cold_h", "cold_n", True))).alias("x")).select("did", "th", "x.*")
    part = lambda c, of: F.sum(F.when(F.col("gram") == of, c))
    weighed = F.col("n") * F.col("value")
    more = one_each.join(values, ["gram", "h"]).groupBy("did", "th").agg(part(weighed, False).alias("base"), part(F.col("n"), False).alias("seen"), part(weighed, True).alias("score"))
    copies = main.groupBy("did", "th").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    a = main.drop("rare_h", "rare_n", "cold_h", "cold_n").alias("a")
    for name, side in (("b", table(more)), ("c", table(copies))):
        a = a.join(side.alias(name), F.col("a.did").eqNullSafe(F.col(f"{name}.did")) & (F.col("a.th") == F.col(f"{name}.th")), "left")
    times = F.coalesce(F.col("c.copies"), F.lit(1))
    extra = lambda c: F.coalesce(F.col(f"b.{c}") / times, F.lit(0.0))
    base = F.col("a.base") + extra("base") - F.col("a.n_tokens") * F.lit(float(np.log10(n + v + 1)))
    known = F.col("a.known") + F.coalesce((F.col("b.seen") / times).cast("long"), F.lit(0))
    return a.select(
        F.col("a.did").alias(id_col), "a.held_out", "a.n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("a.score") + extra("score")).alias("score"))
