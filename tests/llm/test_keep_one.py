"""One document of each component stays, whatever its id."""

from collections import Counter

from corpusloom.llm import simhash

UNLIKE = ["the quick brown fox jumps over the lazy dog near a river", "eleven boxes of apples went north by train last week", "no one knows where these old maps were drawn or why", "a choir sang in the empty hall until the lamps went out"]


def test_null_ids_and_shared_ids(spark):
    rows = [(None, t) for t in UNLIKE[:2]] * 2 + [(7, t) for t in UNLIKE[2:]] * 2 + [(None, UNLIKE[2]), (9, UNLIKE[3]), (9, UNLIKE[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == {(9, UNLIKE[0]): 1, (None, UNLIKE[1]): 1, (7, UNLIKE[2]): 1, (7, UNLIKE[3]): 1}
