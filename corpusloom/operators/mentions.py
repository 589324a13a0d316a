"""Mentions: entity strings of several tables as one list to link, and the structural tables around a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fixed
from corpusloom.operators.order import first_wins


def context(df: DataFrame, linked: str, cap: int = 400) -> Column:
    """`column: value` of a row's other columns, ids and empty cells left out."""
    cells = [F.when(T.filled(F.col(c)) != "", F.concat(F.lit(f"{c}: "), T.strip(F.col(c)))) for c in df.columns if c != linked and not c.endswith("_id")]
    return F.substring(F.concat_ws("; ", *cells), 1, cap) if cells else F.lit("")


def of_table(df: DataFrame, source: str, column: str, id_col: str, kind: str, rank: int, position: str, acronyms: dict[str, str]) -> DataFrame:
    """(key, rank, pos, text, text_raw, source, source_row_id, source_column, type, source_text) of a table's strings."""
    raw = T.strip(T.filled(F.col(column)))
    text = T.squeeze(T.expand(raw, acronyms, longest_first=True))
    return df.select(
        F.lower(text).alias("key"), F.lit(rank).alias("rank"), F.col(position).alias("pos"), text.alias("text"), raw.alias("text_raw"), F.lit(source).alias("source"),
        F.col(id_col).alias("source_row_id"), F.lit(column).alias("source_column"), F.lit(kind).alias("type"), context(df.drop(position), column).alias("source_text")).where("key <> ''")


def united(*tables: DataFrame) -> DataFrame:
    """One mention for each expanded lower-cased text over all tables, the first by table and row."""
    return first_wins(reduce(lambda a, b: a.unionByName(b), tables), ["key"], ["rank", "pos"])


def contains(recommendations: DataFrame, condition_id: str) -> DataFrame:
    """(guideline_id, contains_id, condition_id, rec_id): a document's recommendations with its one condition; a document without any gets a row with none."""
    docs = recommendations.select("guideline_id").distinct()
    recs = recommendations.where(T.filled(F.col("rec_id")) != "").select("guideline_id", "rec_id").distinct()
    rows = docs.join(recs, "guideline_id", "left").select("guideline_id", F.lit(condition_id).alias("condition_id"), T.filled(F.col("rec_id")).alias("rec_id"))
    return rows.withColumn("contains_id", F.concat(F.lit("contains_"), T.slug(F.when(F.col("rec_id") == "", F.col("guideline_id")).otherwise(F.col("rec_id")))))


def pairs(entities: DataFrame, id_col: str, condition_id: str) -> DataFrame:
    """(guideline_id, condition_id, id): a document's one condition with each of its entities."""
    return entities.where(T.filled(F.col(id_col)) != "").select("guideline_id", F.lit(condition_id).alias("condition_id"), id_col).distinct()


def condition(blocks: DataFrame, titles: tuple[str, ...], disease: str, position: str = "block_no", first: int = 10, later: int = 15) -> DataFrame:
    """(doc, condition_id, conditionName): of a title in the first blocks, else the first disease named in a few more, else unknown. Contents blocks don't count."""
    dotted = T.count_of(F.col("text"), r"\.{3,}") + T.count_of(F.col("text"), r"(?:\.\s){3,}")
    rows = blocks.where((F.col(position) < later) & (dotted < 3))
    clean = lambda c: cleaned_condition(c)
    title = F.coalesce(*(clean(F.nullif(F.regexp_extract("text", p, 1), F.lit(""))) for p in titles))
    named = F.nullif(T.strip(F.regexp_extract("text", disease, 1)), F.lit(""))
    rows = rows.select("doc", position, F.when(F.col(position) < first, title).alias("title"), named.alias("named"))
    by = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position)))
    found = blocks.select("doc").distinct().join(rows.groupBy("doc").agg(by("title").alias("t"), by("named").alias("n")), "doc", "left")
    name = F.coalesce("t", "n", F.lit("Unknown Condition"))
    return found.select("doc", F.when(F.coalesce("t", "n").isNull(), "Unknown").otherwise(T.slug(name)).alias("condition_id"), name.alias("conditionName"))


def cleaned_condition(c: Column) -> Column:
    """A condition's name of a title's rest, null if it is none."""
    name = T.strip(F.regexp_replace(c, fixed.CONDITION_BRACKETS, " "))
    name = T.strip(F.get(F.split(name, fixed.CONDITION_BREAK), F.lit(0)))
    for pattern in fixed.CONDITION_REST:
        name = T.strip(F.regexp_replace(name, pattern, ""))
    inner = T.strip(F.regexp_extract(name, fixed.CONDITION_PATIENTS, 1))
    name = T.strip(F.regexp_replace(F.when(inner != "", inner).otherwise(name), fixed.CONDITION_CARE, ""))
    good = ~(name.rlike(fixed.CONDITION_THERAPY) & ~name.rlike(fixed.CONDITION_DISEASE))
    name = F.rtrim(T.squeeze(name), F.lit(" ,;:"))
    for pattern in fixed.CONDITION_REJECT:
        good = good & ~name.rlike(pattern)
    return F.when(good & F.length(name).between(3, 80), name)


def plan(spark: SparkSession, ontology: list[tuple[str, str, str]]) -> DataFrame:
    """(name, kind, detail) rows of an ontology that `readers.turtle` has read."""
    return spark.createDataFrame(ontology, "name string, kind string, detail string")
