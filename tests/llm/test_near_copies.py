"""Near copies against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from corpusloom.llm import near_copies, simhash


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    x, y = sets
    return 1.0 if x == y else len(x & y) / len(x | y)


def groups(texts):
    root = list(range(len(texts)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 - 1e-9:
                a, b = sorted((of(i), of(j)))
                root[b] = a
    return [of(i) for i in range(len(texts))]


def corpus():
    """Clusters of texts with changed words, some of them chains, and a line that many share."""
    rng, out = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(400)]
    line = "this very common line stands in many texts of the whole corpus"
    for c in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t) + (" " + line if rng.random() < 0.4 else ""))
            if rng.random() < 0.3:
                base = t
    return [*out, "", None, "a b", "A  b", "a c", line, line + " too"]


@pytest.mark.parametrize("crowded", [4, 0])
def test_near_copies_against_all_pairs(spark, crowded):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = groups(texts)
    got = {}
    for r in near_copies.near_copies(docs, crowded=crowded).collect():
        got.setdefault(r["__to"], set()).add(r["__id"])
    expected = {}
    for i, g in enumerate(want):
        expected.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert len(expected) < 0.6 * len(texts)
    kept = near_copies.keep_one(docs, crowded=crowded)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_pipeline_drops_near_copies(spark, sf):
    base = [f"word{i}" for i in range(100)]
    near = [*base[:50], "changed", *base[51:]]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "a", 1), (2, " ".join(near), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert bin((simhash.fingerprint_of(" ".join(base)) ^ simhash.fingerprint_of(" ".join(near))) % (1 << 64)).count("1") > 2
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf).collect()] == [1]


def test_bitmaps_never_reject_alike_sets(spark):
    """Sets at the threshold and just below, of sizes whose bitmaps differ in length."""
    rng, rows, pairs = random.Random(7), [], []
    for k, n in enumerate([1, 3, 5, 15, 16, 17, 20, 63, 64, 65, 80, 300, 1000, 1025] * 6):
        a = [rng.getrandbits(64) for _ in range(n)]
        gone = rng.randrange(0, n // 4 + 1)
        new = rng.randrange(0, n // 4 + 1)
        b = a[gone:] + [rng.getrandbits(64) for _ in range(new)]
        for i, x in ((2 * k, a), (2 * k + 1, b)):
            rows.append((i, len(x), near_copies.bitmap(np.array(sorted(x), np.uint64)).tolist()))
        pairs.append((2 * k, 2 * k + 1, (n - gone) / (n + new)))
    near = spark.createDataFrame(rows, "code long, n int, bits array<long>")
    passed = {(r.a, r.b) for r in near_copies.plausible(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), near, 0.8).collect()}
    assert {p[:2] for p in pairs if p[2] >= 0.8} <= passed
    assert len(passed) < 1.3 * sum(p[2] >= 0.8 for p in pairs)
