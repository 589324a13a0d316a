"""Page layout: reading order, header and margin blocks, nearest captions, where references begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_PAGE = ["doc", "page"]


def largest_gap(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, gap, boundary): the widest step between neighbouring values, the first on a tie, and its middle."""
    order = Window.partitionBy(*keys).orderBy(value)
    steps = rows.select(*keys, value, (F.lead(value).over(order) - F.col(value)).alias("__gap"))
    best = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("__gap", value), F.when(F.col("__gap").isNotNull(), F.struct(-F.col("__gap"), F.col(value)))).alias("__b"))
    return best.select(*keys, "n", F.col("__b.__gap").alias("gap"), (F.col(f"__b.{value}") + F.col("__b.__gap") / 2).alias("boundary"))


def reading_order(blocks: DataFrame, pages: DataFrame, least: int = 8, share: float = 0.22, side: int = 3) -> DataFrame:
    """blocks (doc, page, x0, y0, ...) with `column` and `place`: two columns if a gap cuts the page, else one."""
    cut = largest_gap(blocks, _PAGE, "x0").join(pages.select(*_PAGE, "width"), _PAGE)
    cut = cut.where((F.col("n") >= least) & (F.col("width") > 0) & (F.col("gap") >= share * F.col("width"))).select(*_PAGE, "boundary")
    rows = blocks.join(cut, _PAGE, "left").withColumn("column", F.when(F.col("x0") >= F.col("boundary"), 1).otherwise(0))
    every = Window.partitionBy(*_PAGE)
    right = F.sum("column").over(every)
    enough = (right >= side) & (F.count(F.lit(1)).over(every) - right >= side)
    rows = rows.withColumn("column", F.when(enough, F.col("column")).otherwise(0)).drop("boundary")
    return rows.withColumn("place", F.row_number().over(every.orderBy("column", "y0", "x0", "block_no")))


def is_header_footer(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    at_edge = (y0 <= 0.12 * height) | (y1 >= 0.90 * height)
    form = (
        text.rlike(r"(?i)^page\s+\d+|^\d+\s+of\s+\d+") | text.rlike(r"^\d{1,4}$") | text.rlike(r"^[A-Z]{2,}\s+[A-Z][a-z].*\s+\d{1,4}$")
        | text.rlike(r"^\d{1,4}\s+[A-Z]{2,}\s+[A-Z][a-z]") | ((F.upper(text) == text) & (F.lower(text) != text) & (T.n_words(text) <= 6)))
    return (T.strip(text) == "") | ((height > 0) & at_edge & ((F.length(text) < 3) | ((F.length(text) < 80) & form)))


def is_side_margin(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    narrow = (x1 - x0 <= 0.12 * width) & (y1 - y0 >= 0.18 * height) & ((x0 <= 0.08 * width) | (x1 >= 0.92 * width))
    return (T.strip(text) != "") & (width > 0) & (height > 0) & narrow & (F.coalesce(T.caps_share(text), F.lit(1.0)) >= 0.65)


def kept_blocks(blocks: DataFrame, pages: DataFrame, front: int = 8) -> DataFrame:
    """Blocks of running text."""
    b = blocks.join(pages.select(*_PAGE, "width", "height"), _PAGE)
    t = F.col("text")
    drop = (
        T.is_artifact(t) | T.is_caption(t) | is_header_footer(t, F.col("y0"), F.col("y1"), F.col("height"))
        | is_side_margin(t, *map(F.col, ("x0", "y0", "x1", "y1", "width", "height"))) | T.is_url(t) | T.is_contents(t) | ((F.col("page") <= front) & T.is_metadata(t)))
    return b.where(~drop).select(*blocks.columns)


def drop_page(text: Column, blocks: Column, page: Column, total: Column, end_zone: int = 15) -> Column:
    """Too short, a list of tables, mostly capitals, or a page of references near the end."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    caps = F.size(F.filter(words, lambda w: F.upper(w) == w))
    lines = F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"\.\s+", ".\n"), "\n"))), T.strip), lambda x: x != "")
    refs = F.size(F.filter(lines, T.is_reference_line))
    return (
        (F.length(T.strip(text)) < 80) | F.substring(F.lower(text), 1, 250).rlike(r"\blist of\s+(?:tables|figures|abbreviations)\b")
        | ((F.size(words) > 50) & (caps / F.greatest(F.size(words), F.lit(1)) > 0.35))
        | ((page > total - end_zone) & (F.size(blocks) >= 5) & (F.size(lines) >= 8) & (refs / F.greatest(F.size(lines), F.lit(1)) >= 0.85)))


def captions(tables: DataFrame, blocks: DataFrame, above: float = 220, below: float = 120, slack: float = 25) -> DataFrame:
    """(doc, page, table_id, caption): the first strict caption just above or below a table, else the nearest loose one above."""
    t = tables.select(*_PAGE, "table_id", F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    b = blocks.select(*_PAGE, "block_no", "y0", "y1", T.strip(F.col("text")).alias("text"))
    pairs = t.join(b, _PAGE)
    up = (F.col("y1") <= F.col("ty0") + slack) & (F.col("ty0") - F.col("y1") <= above)
    down = (F.col("y0") >= F.col("ty1") - slack) & (F.col("y0") - F.col("ty1") <= below)
    strict = F.col("text").rlike(r"(?i)^table\s+\d+[^\n]*$")
    loose = F.col("text").rlike(r"(?i)\btable\s+\d+")
    rank = F.when(strict & (up | down), F.struct(F.lit(0), F.lit(0.0), F.col("block_no"))).when(loose & up, F.struct(F.lit(1), (-F.col("y1")).cast("double"), F.col("block_no")))
    return pairs.groupBy(*_PAGE, "table_id").agg(F.min_by("text", rank).alias("caption"))


def references_cut(pages: DataFrame, least: int = 3, dense: float = 0.13) -> DataFrame:
    """(doc, cut_page) of (doc, page, heading, density): the first page with the heading, else the start of the last dense run."""
    headed = pages.where(F.col("heading") & (F.col("density") >= 0.25)).groupBy("doc").agg(F.min("page").alias("headed"))
    order = Window.partitionBy("doc").orderBy("page")
    rows = pages.where(F.col("density") >= dense).withColumn("isle", F.col("page") - F.row_number().over(order))
    runs = rows.groupBy("doc", "isle").agg(F.min("page").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    runs = runs.groupBy("doc").agg(F.max("start").alias("run"))
    return headed.join(runs, "doc", "full").select("doc", F.coalesce("headed", "run").alias("cut_page"))
