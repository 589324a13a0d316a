"""Near copies: how many steps they take, for each is a shuffle over all partitions."""

import random

import pytest
from test_near_copies import groups

from corpusloom.llm import near_copies, simhash


def variants(n=120, length=60, seed=11):
    """Texts with one or two other words each: most pairs meet under common shingles, some are links."""
    rng = random.Random(seed)
    base, out = [f"w{i}" for i in range(length)], []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice((1, 2))):
            t[rng.randrange(length)] = f"x{i}y{rng.randrange(9)}"
        out.append(" ".join(t))
    return out


def test_a_group_of_near_copies_is_compared_at_once(spark, monkeypatch):
    texts, calls = variants(), []
    real = near_copies.alike
    monkeypatch.setattr(near_copies, "alike", lambda *a: calls.append(a) or real(*a))
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    want = sorted(set(groups(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == want and 1 < len(want) < len(texts)
    assert len(calls) == 1


@pytest.mark.parametrize("rounds", [0, 2])
def test_rounds_find_the_same(spark, monkeypatch, rounds):
    texts, real = variants(), near_copies.linked
    monkeypatch.setattr(near_copies, "linked", lambda *a: real(*a, rounds=rounds))
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowded=0)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(texts)))


def test_small_tables_of_the_component_search_are_few_files(spark, monkeypatch):
    parts, real = [], simhash.table
    monkeypatch.setattr(simhash, "table", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long").coalesce(1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert max(parts) == 1
