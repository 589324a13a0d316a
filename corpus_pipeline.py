"""A training-data pipeline over documents: five stages, each an operator of corpusloom.llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.

- language_id: learned from the documents that are not held out; texts without
  a letter (`und`) and ambiguous ones go.
- line_dedup: later copies of line runs of 50 words or more leave the texts,
  n_chars follows; a document with nothing else goes. Others stay as they are.
- simhash: one document of each near-duplicate group stays, that of the
  smallest id; links are all pairs with a Jaccard of 0.8 or more over five
  words. Fingerprints lose such pairs, so an exact join finds them.
- decontaminate: documents that hold a benchmark item to 0.8 go.
- mixing: how many words the mix takes of each document; documents of which it
  takes none are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, line_dedup, mixing, near_copies
from corpusloom.llm._common import WORD, documents, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs)
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
]

#: A trained classifier and 64-bit hashes aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
