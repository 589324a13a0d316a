"""The queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, license_scan, line_dedup, mixing, pii, ppm, quality_cnn, quality_rules, simhash
from corpusloom.llm._common import documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", pii.spans(F.col("text")).alias("found"))
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.listed(of(*pii.BASE)), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda x: x["label"]))))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["word"].alias("first_word"), F.get("places", F.size("places") - 1)["word"].alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    runs = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["i"], r["e"])), ",")
    return found.select("doc_id", "n_lines", "n_removed", runs.alias("runs"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_rules, op3_simhash, op4_mixing, op5_pii, op6_language, op7_ppm, op8_license, op9_decontamination, op10_line_dedup)}
