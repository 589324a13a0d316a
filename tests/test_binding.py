"""Binding of relations to recommendations: few scans, and the first of equal texts."""

from corpusloom.operators import relations
from corpusloom.plans import relations as plans


def test_relations_are_not_computed_again_for_each_use(spark, sf):
    plan = plans.relation_binding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 60


def test_the_first_of_equal_texts_is_bound_for_every_relation(spark):
    rel = spark.createDataFrame([(1, 1, "give bolt now", ["bolt"]), (2, 1, "give bolt now", ["bolt"]), (3, 2, "give bolt now", ["bolt"]), (4, 1, None, ["bolt"]), (5, 1, "give bolt now", ["nut"])], "k long, page int, passage string, names array<string>")
    recs = spark.createDataFrame([("rec_p1_b", "Give bolt", 9), ("rec_p1_a", " give BOLT ", 7), ("rec_p2_c", "give bolt", 8), ("rec_p1_d", "bolt of another kind", 1), ("rec", "give bolt now", 0)], "rec_id string, text string, position long")
    assert sorted(map(tuple, relations.bound(rel, ["k"], recs).collect())) == [(1, "rec_p1_a"), (2, "rec_p1_a"), (3, "rec_p2_c")]
