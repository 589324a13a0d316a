"""Columns of the caller whose names the operators use inside, and ids of other types."""

import random

import numpy as np
import pytest

from corpusloom.llm import _common, decontaminate, line_dedup, mixing, near_copies, simhash

INNER = ("__cell", "__at", "__th", "__own", "__id", "__did", "__runs", "__cut", "__lines", "__size", "__slice", "__source", "__d", "__t", "stays", "text_", "__CELL_")
PASSAGE = "\n".join(f"line {i} of a passage that many texts share with seven more words here" for i in range(6))


@pytest.fixture(scope="module")
def rows(spark):
    texts = [PASSAGE, "x\n" + PASSAGE, "other words " * 3, None, "", "other words " * 3]
    data = [(i, t, "ab"[i % 2], *([i * 100 + 99] * len(INNER))) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in INNER))


def kept(df):
    assert all(r[c] == r.doc_id * 100 + 99 for r in df.collect() for c in INNER)
    return sorted(r.doc_id for r in df.collect())


def test_columns_of_the_caller_stay(rows):
    assert kept(line_dedup.dedup_lines(rows)) == list(range(6))
    assert kept(mixing.mix(rows)) == list(range(6))
    assert kept(simhash.keep_one(rows)) == [0, 2, 3]
    assert kept(near_copies.keep_one(rows)) == [0, 2, 3]


def test_items_of_any_id(spark):
    docs = spark.createDataFrame([("a", PASSAGE), ("b", "short")], "key string, text string")
    items = spark.createDataFrame([("x", PASSAGE.split("\n")[0]), (None, "SHORT"), ("y", None)], "key string, text string")
    got = decontaminate.contained(docs, items, id_col="key", item_id="key")
    assert got.columns == ["key", "item_key", "n_shared", "n_shingles"]
    assert sorted((r.key, r.item_key) for r in got.collect()) == [("a", "x"), ("b", None)]


def test_items_are_partitioned_by_size():
    rng = random.Random(5)
    items = [(n, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4))) for n in (1, 2, 3, 4, 7, 8, 30, 60, 100, 500)]
    sketches = decontaminate.Sketches([*items, (0, "two words")])
    sizes = [(p.width, sorted(len(sketches.sets[i][2]) for i in p.item)) for p in sketches.partitions]
    assert sizes == [(2, [1]), (5, [1]), (5, [2, 3]), (5, [4, 7]), (5, [8]), (5, [30]), (5, [60]), (5, [100]), (5, [500])]
    lengths = [p.length for p in sketches.partitions]
    assert lengths == [4, 4, 4, 6, 6, 16, 28, 44, 204]
    filler = [f"f{rng.randrange(10**6)}" for _ in range(20_000)]
    for key, text in items:  # a text that holds exactly as many shingles as it takes, and one less
        w = text.split()
        n, need = len(w) - 4, int(np.ceil(0.8 * (len(w) - 4) - 1e-9))
        for shared in (need, need - 1):
            text = " ".join([*filler[:9000], *w[: shared + 4], *filler[9000:]])
            found = {x["item"]: x["n_shared"] for x in sketches.search(text)}
            assert found.get(key, 0) == (shared if shared == need else 0), (n, shared)
            candidates = {i for p in sketches.partitions for i in p.candidates(decontaminate.hashes(decontaminate.words(text), p.width))}
            assert len(candidates) <= 3


def test_targets_over_many_sources(spark):
    rng = random.Random(1)
    sizes = {f"s{i:04}": rng.randrange(0, 1000) ** 2 for i in range(2000)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - 2 * sum(sizes[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        more = {s for s in sizes if level * weights[s] > 2 * sizes[s]}
        if more == full:
            break
        full = more
    assert got == {s: pytest.approx(min(level * weights[s], 2 * sizes[s])) for s in sizes}
    assert sum(got.values()) == pytest.approx(total)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session)
