"""Phrase mining: matches of a pattern by block, and a gate on the number of distinct blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(blocks: DataFrame, block: str, text: Column, pattern: str, group: int = 0) -> DataFrame:
    """(block, pos, span): every match with its place among the block's matches."""
    return blocks.select(block, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("pos", "span"))


def gate(hits: DataFrame, block: str, key: str, least: int = 2) -> DataFrame:
    """(key, span, first_block, freq): keys found in `least` blocks or more, the span of the first hit.

    Pre-aggregated by (key, block), so a frequent key costs a row for each
    task and block, not for each hit.
    """
    one = hits.groupBy(key, block).agg(F.min_by("span", "pos").alias("span"))
    found = one.groupBy(key).agg(F.count(F.lit(1)).alias("freq"), F.min_by("span", block).alias("span"), F.min(block).alias("first_block"))
    return found.where(F.col("freq") >= least).select(key, "span", "first_block", "freq")


def mine(blocks: DataFrame, block: str, text: Column, pattern: str, key: Callable[[Column], Column], clean: Callable[[Column], Column] = lambda s: s, valid: Callable[[Column], Column] = lambda s: F.length(s) > 0, least: int = 2, group: int = 0) -> DataFrame:
    """The shared shape of all text extractors: match, clean, test, key, gate."""
    hits = matches(blocks, block, text, pattern, group).withColumn("span", clean(F.col("span"))).where(valid(F.col("span")))
    return gate(hits.withColumn("key", key(F.col("span"))), block, "key", least)
