"""Documents that hold an item, against a comparison of all pairs."""

from corpusloom.plans import entities


def test_items_whose_edges_are_parts_of_words_are_found(spark, tmp_path):
    texts = ["xxalpha beta gammayy", "alpha beta gamma", "alpha beta\tgamma", "betaalpha", "the alphabet", "a b", " ", "", "\n ", None, "alpha  beta", "zalpha betaz", "xxalpha beta gammayy"]
    items = ["alpha beta gamma", "alpha", "pha be", "alpha beta", " b", "beta ", "alpha beta\tgamma", " ", "", "\n ", None, "lph", "nowhere at all", "no", "alpha"]
    docs = spark.createDataFrame([(i if i not in (3, 12) else 4, t) for i, t in enumerate(texts)] + [(None, "alpha")], "doc_id long, text string")
    own = spark.createDataFrame([(i % 14, t) for i, t in enumerate(items)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entities.containment_pairs(spark, str(tmp_path)).collect()
    want = [(d.doc_id, i.item_id) for d in docs.collect() for i in own.collect() if d.text is not None and i.text is not None and i.text in d.text]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
