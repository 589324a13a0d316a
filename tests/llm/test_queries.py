"""The registered queries against their SQL, and the pipeline stage by stage."""

import numbers

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, line_dedup, oracles, queries


def plain(rows):
    return sorted(repr([None if pd.isna(x) else float(x) if isinstance(x, numbers.Real) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(oracles.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got[cols].itertuples(index=False)) == plain(want[cols].itertuples(index=False))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if name == "line_dedup":
            assert line_dedup.dedup_lines(docs).where("n_removed > 0").count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "decontaminate":
            assert decontaminate.contained(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
            assert before.count() - docs.count() == decontaminate.contained(before, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct().count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0.5 * sizes[0]
    assert docs.agg(F.min("taken")).first()[0] > 0


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
