"""Storyboards, mentions and condition names on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import mentions, storyboard


def test_read_and_put_together(spark):
    board = {"title": "T", "scenes": [{"scene_number": 1, "narration": "One. Two.", "on_screen_text": None}, {"scene_number": "2", "narration": "Three."}]}
    rows = spark.createDataFrame([(1, f"<think>{{}}</think> Sure: {json.dumps(board)} Bye"), (2, "{broken"), (3, None)], "k int, out string").select("k", storyboard.read(F.col("out")).alias("b"))
    assert [r.k for r in rows.where("b is not null and b.title is not null").collect()] == [1]
    p = storyboard.parts(rows.where("k = 1"), "k", "b").orderBy("part").collect()
    assert [(r.scene, r.field, r.text) for r in p] == [(0, "title", "T"), (1, "narration", "One. Two."), (2, "narration", "Three.")]
    s = storyboard.sentences(rows.where("k = 1"), "k", "b")
    assert sorted((r.scene, r.number, r.sentence) for r in s.collect()) == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Three.")]
    v = s.withColumn("label", F.when(F.col("sentence") == "Two.", "SUPPORTED").when(F.col("sentence") == "One.", "CONTRADICTED"))
    out = storyboard.without_flagged(v, "k")
    assert {r.scene: r.text for r in out.collect()} == {1: "Two.", 2: ""} and storyboard.emptied(out).count() == 1
    assert rows.select(storyboard.scene_number(F.lit(" 3 "))).first()[0] == 3


def test_facts(spark):
    df = spark.createDataFrame([(["a", "b"], ["H", "I", "J"])], "f array<string>, h array<string>")
    assert df.select(storyboard.numbered(F.col("f")), storyboard.with_context(F.lit("t"), F.col("h"))).first() == ("1. a\n2. b", "[H > I] t")
    v = spark.createDataFrame([(1, 2), (1, 9), (1, None)], "k int, fact int")
    facts = spark.createDataFrame([(1, ["a", "b"])], "k int, facts array<string>")
    assert sorted(map(repr, (r.fact_text for r in storyboard.report(v, facts, "k").collect()))) == ["'b'", "None", "None"]


@pytest.mark.parametrize(("text", "want"), [
    ("acute and chronic heart failure: Developed by the Task Force", "acute and chronic heart failure"), ("cardiac pacing", None), ("patients with atrial fibrillation (AF)", "atrial fibrillation"),
    ("exercise in patients with heart disease", "heart disease"), ("the Task Force", None), ("x", None), (None, None)])
def test_condition_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(mentions.cleaned_condition(F.col("t"))).first()[0] == want


def test_condition_identity(spark):
    blocks = spark.createDataFrame([
        ("a", 0, "Contents ..... 1 ..... 2 ..... 3 guidelines for the management of nothing"), ("a", 1, "Guidelines for the management of heart failure. More"), ("b", 12, "text on cardiomyopathy here"), ("c", 0, "nothing")], "doc string, block_no int, text string")
    got = mentions.condition(blocks, (r"(?i)guidelines?\s+for\s+(?:the\s+)?management\s+of\s+([^.\n]{3,80})",), r"(?i)\b(cardiomyopathy)\b")
    assert {r.doc: (r.condition_id, r.conditionName) for r in got.collect()} == {"a": ("heart_failure", "heart failure"), "b": ("cardiomyopathy", "cardiomyopathy"), "c": ("Unknown", "Unknown Condition")}


def test_structural_tables(spark):
    recs = spark.createDataFrame([("g", "r1"), ("g", "r1"), ("g", ""), ("h", None)], "guideline_id string, rec_id string")
    assert sorted(tuple(r) for r in mentions.contains(recs, "c").collect()) == [("g", "c", "r1", "contains_r1"), ("h", "c", "", "contains_h")]
    assert mentions.pairs(recs, "rec_id", "c").collect() == [("g", "c", "r1")]
    assert mentions.plan(spark, [("A", "class", "")]).count() == 1
