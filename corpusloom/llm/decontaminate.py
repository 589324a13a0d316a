"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (the query set) are partitioned by their number n of distinct shingles
of five words: one partition for each power of two. A partition whose largest
item has u shingles gives its items MinHash signatures of one length,
m = 2 * (u - ceil(threshold * u)) + LEAST: an item's m smallest shingle hashes
(all of them, if it has fewer). A text's MinHash for the partition is all that
it has among its hashes up to the partition's largest signature value, so it
is as fine for a short item inside a long text as for one alone.

Signatures are compared: a text that holds at least threshold * n of an item's
n shingles misses at most d = n - ceil(threshold * n) of them, so of the
item's signature it shares all values but d at least. Items that pass are
candidates; none that a text holds is missed. Each is verified by exact
containment over the shingles themselves.

The tables that texts probe are broadcast; a block of items is limited to
`block_shingles` shingles, and more items mean more blocks, each run over all
texts. Nothing is shuffled.

Words: A-Z lower-cased, between ASCII white space. An item of fewer than five
words is one shingle, its whole word sequence, and is sought as such. Null or
empty texts and items match nothing. Repeated rows give repeated results,
repeated items each their own. Ids are of any type, null included; if texts'
and items' ids have one name, the items' gets `item_` before it. Empty tables
give empty results. Other columns are kept by `clean`, not looked at else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import LOWER_BYTES

WIDTH, THRESHOLD, BLOCK_SHINGLES, LEAST = 5, 0.8, 1_000_000, 4
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_BITS = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words."""
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        out ^= out >> np.uint64(29)
    return out


class Partition:
    """The signatures of the items of one shingle width whose sizes lie between two powers of two."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], threshold: float):
        """items: (number of the item, its distinct shingle hashes in order)."""
        self.width = width
        miss = lambda n: n - math.ceil(threshold * n - 1e-9)
        self.length = 2 * miss(max(len(h) for _, h in items)) + LEAST
        signatures = [h[: self.length] for _, h in items]
        self.item = np.array([i for i, _ in items])
        self.need = np.array([len(s) - miss(len(h)) for s, (_, h) in zip(signatures, items, strict=True)])
        values, owner = np.concatenate(signatures), np.repeat(np.arange(len(items)), [len(s) for s in signatures])
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]  # of each value its items, one value after another
        self.keys, self.start = np.unique(values[order], return_index=True)
        self.start = np.append(self.start, len(values))
        self.there = np.zeros(1 << _BITS, bool)
        self.there[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> list[int]:
        """The items whose signature the shingle hashes of a text share enough of."""
        h = np.unique(h[self.there[(h >> np.uint64(64 - _BITS)).astype(np.int64)]])
        h = h[h <= self.keys[-1]]  # the text's MinHash at this partition
        if not len(h):
            return []
        at = np.searchsorted(self.keys, h)
        at = at[self.keys[at] == h]
        if not len(at):
            return []
        hit = np.concatenate([self.owner[self.start[i] : self.start[i + 1]] for i in at.tolist()])
        which, shared = np.unique(hit, return_counts=True)
        return self.item[which[shared >= self.need[which]]].tolist()


class Sketches:
    """A block of items, by shingle width and size."""

    def __init__(self, items: list[tuple], width: int = WIDTH, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets: list[tuple] = []  # id, width, shingles
        parts: dict[tuple[int, int], list] = {}
        for key, text in items:
            tokens = words(text)
            if not tokens:
                continue
            w = min(width, len(tokens))
            h = np.unique(hashes(tokens, w))
            parts.setdefault((w, len(h).bit_length()), []).append((len(self.sets), h))
            self.sets.append((key, w, frozenset(tuple(tokens[i : i + w]) for i in range(len(tokens) - w + 1))))
        self.partitions = [Partition(w, found, threshold) for (w, _), found in sorted(parts.items())]

    def search(self, text: str | None) -> list[dict]:
        """Items of the block that the text holds."""
        tokens, near, at_width = words(text), set(), {}
        for part in self.partitions:
            if part.width not in at_width:
                at_width[part.width] = hashes(tokens, part.width)
            near.update(part.candidates(at_width[part.width]))
        out, own = [], {}
        for i in sorted(near):
            key, w, shingles = self.sets[i]
            if w not in own:
                own[w] = {tuple(tokens[j : j + w]) for j in range(len(tokens) - w + 1)}
            shared = len(own[w] & shingles)
            if shared >= self.threshold * len(shingles) - 1e-9:
                out.append({"item": key, "n_shared": shared, "n_shingles": len(shingles)})
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_shingles: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of a bounded number of words, read partition by partition."""
    block, size = [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(row[1].split())
        if block and size + n > block_shingles:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def held(text: Column, sketches: Sketches, id_type: str = "bigint") -> Column:
    """array<struct<item, n_shared, n_shingles>>: the items of a block that a text holds; id_type: of the items' ids."""

    @F.pandas_udf(f"array<struct<item:{id_type},n_shared:bigint,n_shingles:bigint>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sketches.search(t) for t in texts], dtype=object)

    return search(text)


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, item_id, n_shared, n_shingles) for every text and item that it holds."""
    out, kind = None, items.schema[item_id].dataType.simpleString()
    name = item_id if item_id.lower() != id_col.lower() else f"item_{item_id}"
    for block in blocks(items, item_id, item_text, block_shingles):
        hits = docs.select(F.col(id_col).alias("__id"), F.explode(held(F.col(text_col), Sketches(block, width, threshold), kind)).alias("__hit"))
        found = hits.select(F.col("__id").alias(id_col), F.col("__hit.item").alias(name), "__hit.n_shared", "__hit.n_shingles")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of `docs` whose text holds none of the items."""
    kind = items.schema[item_id].dataType.simpleString()
    for block in blocks(items, item_id, item_text, block_shingles):
        docs = docs.where(F.size(held(F.col(text_col), Sketches(block, width, threshold), kind)) == 0)
    return docs
