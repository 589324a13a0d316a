"""Positioned text blocks as a table, and what only Python can do to their text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import layout
from corpusloom.sources.readers import BLOCK_SCHEMA


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return normal(c)


def scan(spark: SparkSession, path: str, reader: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Blocks of binary documents by an injected reader: bytes to (page, x0, y0, x1, y1, text); a document that fails has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path_, page, i, *box) for i, (page, *box) in enumerate(reader(content)) if str(box[-1]).strip()]
                except Exception:  # one unreadable document doesn't end the scan
                    continue
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, BLOCK_SCHEMA)


def pages(blocks: DataFrame, sizes: DataFrame, least: int = 80, glue: str = "", acronyms: dict[str, str] | None = None) -> DataFrame:
    """(doc, page, text): blocks kept and cleaned, in reading order, joined by blank lines; short pages left out."""
    kept = layout.reading_order(layout.kept_blocks(blocks.withColumn("text", T.clean_block(nfkc(F.col("text")), glue)), sizes), sizes)
    rows = kept.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b"))  # the blocks of one page
    rows = rows.withColumn("parts", F.transform("b", lambda x: x["text"])).withColumn("last", F.lit(None).cast("int"))
    total = rows.groupBy("doc").agg(F.max("page").alias("total"))
    text = T.merged_paragraphs(F.regexp_replace(F.array_join("parts", "\n\n"), r"(?i)^\s*[^\n]*et\s+al\.?[^\n]*\d{4}[^\n]*Guidelines?\s*", ""))
    rows = rows.join(total, "doc").withColumn("text", text)
    rows = rows.where((F.length(T.strip(F.col("text"))) >= least) & ~layout.drop_page(F.col("text"), F.col("parts"), F.col("page"), F.col("total")))
    return rows.select("doc", "page", (T.expand(F.col("text"), acronyms) if acronyms else F.col("text")).alias("text"))
