"""Written storyboards: reading them, checking them sentence by sentence, and what the checks add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SCHEMA = "title string, scenes array<struct<scene_number:string,narration:string,visual_description:string,on_screen_text:string>>, not_covered array<string>"
CHECKED = ("narration", "on_screen_text")
KEPT = ("SUPPORTED", "NO_CLAIM")


def read(output: Column) -> Column:
    """The storyboard in an output: from its first to its last brace, without thinking; null if that can't be read."""
    plain = F.regexp_replace(T.filled(output), r"(?s)<think>.*?</think>", "")
    return F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")), SCHEMA)


def scene_number(c: Column) -> Column:
    """A scene's number, which may arrive as text."""
    return F.trim(c).try_cast("int")


def parts(boards: DataFrame, key: str, board: str) -> DataFrame:
    """(key, part, scene, field, text): what a viewer sees or hears, in order; the title has scene 0."""
    b = F.col(board)
    title = F.array(F.struct(F.lit(0).alias("scene"), F.lit("title").alias("field"), b["title"].alias("text")))
    fields = ("narration", "visual_description", "on_screen_text")
    scenes = F.flatten(F.transform(b["scenes"], lambda s, i: F.array(*(F.struct((i + 1).alias("scene"), F.lit(f).alias("field"), s[f].alias("text")) for f in fields))))
    every = F.concat(title, F.coalesce(scenes, F.array().cast("array<struct<scene:int,field:string,text:string>>")))
    return boards.select(key, F.posexplode(every).alias("part", "x")).where("x.text is not null").select(key, "part", "x.*")


def sentences(boards: DataFrame, key: str, board: str, fields: tuple[str, ...] = CHECKED) -> DataFrame:
    """(key, part, scene, field, number, sentence): the sentences that are checked."""
    p = parts(boards, key, board).where(F.col("field").isin(*fields))
    return p.select(key, "part", "scene", "field", F.posexplode(T.pieces(F.col("text"))).alias("number", "sentence"))


def without_flagged(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, part, scene, field, text): fields put together again from the sentences that may stay; a missing verdict removes one."""
    kept = F.when(T.filled(F.col("label")).isin(*KEPT), F.struct("number", "sentence"))
    rows = verdicts.groupBy(key, "part", "scene", "field").agg(F.array_sort(F.collect_list(kept)).alias("s"))  # the sentences of one field
    return rows.select(key, "part", "scene", "field", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text"))


def emptied(fields: DataFrame) -> DataFrame:
    return fields.where("text = ''")


def summary(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, n, supported, contradicted, not_supported, no_claim, removed, support): counts by label; support is the share of claims that are supported, 1 without claims."""
    label = T.filled(F.col("label"))
    count = lambda x: F.count_if(label == x)
    rows = verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), count("SUPPORTED").alias("supported"), count("CONTRADICTED").alias("contradicted"), count("NOT_SUPPORTED").alias("not_supported"),
        count("NO_CLAIM").alias("no_claim"), F.count_if(~label.isin(*KEPT)).alias("removed"))
    claims = F.col("n") - F.col("no_claim")
    return rows.withColumn("support", F.when(claims > 0, F.round(F.col("supported") / claims, 6)).otherwise(1.0))


def fact_coverage(verdicts: DataFrame, key: str, enough: int = 3) -> DataFrame:
    """(key, facts, coverage): distinct facts that support a sentence, as a share of `enough`."""
    used = verdicts.where("label = 'SUPPORTED'").groupBy(key).agg(F.count_distinct("fact").alias("facts"))
    every = verdicts.select(key).distinct().join(used, key, "left").select(key, F.coalesce("facts", F.lit(0)).alias("facts"))
    return every.withColumn("coverage", F.round(F.least(F.col("facts") / enough, F.lit(1.0)), 6))


def numbered(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda f, i: F.concat_ws(". ", i + 1, f)), "\n")


def with_context(text: Column, headers: Column) -> Column:
    """A fact behind its first two section headers."""
    head = F.array_join(F.slice(headers, 1, 2), " > ")
    return F.when(F.size(headers) > 0, F.concat(F.lit("["), head, F.lit("] "), text)).otherwise(text)


def report(verdicts: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Verdicts with the text of the fact that they name by its place from 1."""
    rows = verdicts.join(facts.select(key, "facts"), key, "left")
    there = F.col("fact").between(1, F.size("facts"))
    return rows.withColumn("fact_text", F.when(there, F.try_element_at("facts", F.col("fact").cast("int")))).drop("facts")


def chosen(picks: Column, facts: Column, most: int = 6) -> Column:
    """The facts that a model's numbers (from 1) pick: each number once, in its order, those out of range left out, `most` at most."""
    good = F.array_distinct(F.filter(picks, lambda p: (p > 0) & (p <= F.size(facts))))
    return F.transform(F.slice(good, F.lit(1), F.lit(most)), lambda p: F.get(facts, p - 1))
