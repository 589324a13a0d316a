"""Folded bitmaps: no link is lost, and unlike sets are told apart where they meet."""

import numpy as np

from corpusloom.llm import near_copies as N


def test_folded_bitmaps_keep_all_links_and_drop_unlike_sets(spark):
    rng = np.random.default_rng(7)
    rows, real = [], []
    for i, n in enumerate((1, 5, 16, 17, 32, 33, 64, 65, 200, 400) * 6):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 10], rng.integers(0, 2**63, len(a) // 10, dtype=np.uint64)])) if i % 2 else np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        real.append(both >= 0.8 * (len(a) + len(b) - both))
        rows.append((i, (len(a), N.bitmap(a).tolist()), (len(b), N.bitmap(b).tolist())))
    df = spark.createDataFrame(rows, "i int, p struct<n:int,bits:array<long>>, q struct<n:int,bits:array<long>>")
    from pyspark.sql import functions as F

    df = df.select("i", *(F.struct(F.col(f"{c}.n"), *N.folds(F.col(f"{c}.bits"))).alias(c) for c in "pq"))
    kept = {r.i for r in df.where(N.near_enough("p", "q", 0.8)).collect()}
    assert {i for i, x in enumerate(real) if x} <= kept
    assert not {i for i, (x, r) in enumerate(zip(real, rows)) if not x and r[1][0] >= 16 and i % 2 == 0} & kept
