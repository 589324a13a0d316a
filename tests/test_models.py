"""The model surface: cached answers, batches that a model judges."""

from corpusloom.operators import models


def test_a_cache_of_cache_key_hits(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("b",), ("é",)], "prompt string")
    key = lambda p: models.cache_key(p, "be brief", temperature=0)
    cache = spark.createDataFrame([(key("a"), "old", 0), (key("a"), "later", 1), (models.cache_key("b"), "of another system", 2)], "key string, answer string, line_no long")
    got = {r.key: r.answer for r in models.answered(prompts, "prompt", cache, models.Scripted("new"), "be brief", temperature=0).collect()}
    assert got == {key("a"): "later", key("b"): "new", key("é"): "new"}


def test_verdicts_in_batches(spark):
    texts = ["x" * n for n in range(1, 40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.kept for r in models.validated(rows, "id", "text", models.LengthJudge(20), batch=4).collect()}
    assert got == {i: len(t) <= 20 for i, t in enumerate(texts)}
