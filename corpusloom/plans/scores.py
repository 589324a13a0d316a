"""Queries over scores and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import mentions, models, scoring, storyboard
from corpusloom.plans._tables import read


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a unit that stands for itself: text is built from ids, as the documents hold few."""
    o = read(spark, d, "orders")
    text = F.concat(F.lit("Take "), (F.col("o_orderkey") % 37).cast("string"), F.lit(" mg for "), (F.col("o_custkey") % 9).cast("string"), F.lit(" days or "), F.col("o_orderkey").cast("string"), F.lit(" times."))
    q = F.transform(scoring.quantities(text), lambda x: F.concat_ws(" ", x["value"].cast("long"), x["unit"]))
    return o.select("o_orderkey", F.array_join(F.array_sort(q), ",").alias("found"))


def number_precision(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.quantities(F.regexp_replace("text", "[^0-9 ]", " "))
    allowed = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 5).cast("double").alias("value"), F.lit(None).cast("string").alias("unit")))
    return read(spark, d, "documents").select("doc_id", F.round(scoring.number_precision(found, allowed), 6).alias("precision"))


def key_point_coverage(spark: SparkSession, d: str) -> DataFrame:
    anchors = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("mentation*")), F.array(F.lit("que la"), F.lit("to the")))
    return read(spark, d, "benchmark").select("item_id", F.round(scoring.share_true(scoring.key_points_said(F.col("text"), anchors)), 6).alias("coverage"))


def readability(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.round(scoring.readability({"text": F.col("text")}), 6).alias("score"))


def silent_zero(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", scoring.unless_silent(F.col("text"), F.lit(1.0)).alias("score"))


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 5 / 4.0).alias("support"), (F.col("turn") % 3 / 2.0).alias("coverage"), (F.col("conv_id") % 2).cast("double").alias("readability"), F.lit(1.0).alias("format"))
    return c.select("conv_id", "turn", F.round(scoring.weighted({k: F.col(k) for k in scoring.WEIGHTS}, scoring.WEIGHTS), 6).alias("score"))


def verdict_decide(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of the boxes that change a label, by the bits of a number."""
    bit = lambda i: F.col("id").bitwiseAND(F.lit(1 << i)) != 0
    yes = lambda i: F.when(bit(i), "yes").otherwise("no")
    box = F.struct(
        F.when(bit(0), "true").otherwise("False").alias("medical_statement"), F.when(bit(1), "2").otherwise("9").alias("fact"), yes(2).alias("conflicts"), yes(3).alias("states_it"),
        yes(4).alias("same_people"), F.when(bit(5), "Everyone.").when(bit(6), "women").otherwise("").alias("fact_is_about"), F.when(bit(7), "women").otherwise("").alias("sentence_is_about"),
        F.when(bit(8), F.array(F.lit("a dose"))).otherwise(F.array(F.lit("None"))).alias("added"))
    return spark.range(512).select("id", scoring.decide(box, F.lit(3)).alias("label"))


def tournament_select(spark: SparkSession, d: str) -> DataFrame:
    scores = {r["conv_id"]: float(r["n"]) for r in read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    return spark.createDataFrame(list(enumerate(models.tournament(sorted(scores.items()), 3, seed=42))), "slot long, conv_id long")


def fake_model_validate(spark: SparkSession, d: str) -> DataFrame:
    """Keep or reject in batches; a line that can't be read keeps its row."""
    rows = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return models.validated(rows, "id", "text", models.LengthJudge(200), batch=15)


def _boards(spark: SparkSession, d: str) -> DataFrame:
    """A storyboard in JSON of each conversation's turns, with words around it."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("t"))
    scenes = F.transform("t", lambda x: F.struct(x["turn"].cast("string").alias("scene_number"), x["t"].alias("narration"), F.lit("Short text. Seen!").alias("on_screen_text")))
    output = F.concat(F.lit("<think>{no}</think> Here: "), F.to_json(F.struct(F.lit("A title").alias("title"), scenes.alias("scenes"))), F.lit(" done"))
    return c.select("conv_id", storyboard.read(output).alias("board"))


def storyboard_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = storyboard.sentences(_boards(spark, d), "conv_id", "board", ("on_screen_text",))
    return rows.select("conv_id", F.col("scene").cast("long").alias("scene"), F.col("number").cast("long").alias("number"), "sentence")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("SUPPORTED", "NO_CLAIM", "NOT_SUPPORTED", "CONTRADICTED", "ERROR"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = read(spark, d, "events")
    return e.select("user_id", F.floor(F.col("event_id") / 30).alias("part"), F.lit(1).alias("scene"), F.col("event_type").alias("field"), F.col("event_id").alias("number"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sentence"), label.alias("label"), (F.col("event_id") % 4).alias("fact"))


def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    v = _verdicts(spark, d)
    return storyboard.summary(v, "user_id").join(storyboard.fact_coverage(v, "user_id"), "user_id")


def remove_flagged(spark: SparkSession, d: str) -> DataFrame:
    return storyboard.without_flagged(_verdicts(spark, d), "user_id").select("user_id", "part", "field", "text")


def mention_rows(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("n_id"), "n_nationkey", F.lit("x").alias("kind"))
    r = read(spark, d, "region").select(F.lower("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("r_id"), "r_regionkey", F.lit("").alias("note"))
    short = {"nation": "NATION", "nation_1": "first nation"}
    rows = mentions.united(
        mentions.of_table(n, "S_nation", "name", "n_id", "nation", 0, "n_nationkey", short), mentions.of_table(r, "S_region", "name", "r_id", "region", 1, "r_regionkey", short),
        mentions.of_table(n, "S_again", "name", "n_id", "again", 2, "n_nationkey", short))
    return rows.select("key", "text", "text_raw", "source", "source_row_id", "type", "source_text")


QUERIES = {f.__name__: f for f in (quantities, number_precision, key_point_coverage, readability, silent_zero, weighted_score, verdict_decide, tournament_select, fake_model_validate, storyboard_sentences, verdict_summary, remove_flagged, mention_rows)}

_S = r"[ \t\n\v\f\r]"
_SQ = f"trim(regexp_replace({{}}, '{_S}+', ' ', 'g'))"
_N = f"CASE WHEN {_SQ.format('{0}')} = '' THEN 0 ELSE len(string_split({_SQ.format('{0}')}, ' ')) END"
_NORM = "regexp_replace(regexp_replace(replace(regexp_replace(lower(text), '(\\d)([a-z%])', '\\1 \\2', 'g'), '%', ' percent'), '[-‐‑‒–—―/]', ' ', 'g'), '\\s+', ' ', 'g')"
_PIECES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])["'')\]},]*\s+', '\1' || chr(1), 'g'), '"[\w -]{1,30}"\s*:|\\n|\n', chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))"""

_VERDICTS = "SELECT user_id, event_id // 30 AS part, event_type AS field, event_id, event_id % 5 AS k, event_id % 4 AS fact FROM events"

ORACLES = {
    "storyboard_sentences": "SELECT conv_id, s AS scene, n AS number, CASE n WHEN 0 THEN 'Short text.' ELSE 'Seen!' END AS sentence FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS s FROM conversations), range(2) t(n)",
    "verdict_summary": f"""SELECT user_id, count(*) AS n, count(*) FILTER (k = 0) AS supported, count(*) FILTER (k = 3) AS contradicted, count(*) FILTER (k = 2) AS not_supported, count(*) FILTER (k = 1) AS no_claim,
        count(*) FILTER (k > 1) AS removed, CASE WHEN count(*) FILTER (k <> 1) > 0 THEN round(count(*) FILTER (k = 0) / count(*) FILTER (k <> 1), 6) ELSE 1.0::DOUBLE END AS support,
        count(DISTINCT fact) FILTER (k = 0) AS facts, round(least(count(DISTINCT fact) FILTER (k = 0) / 3, 1.0::DOUBLE), 6) AS coverage FROM ({_VERDICTS}) GROUP BY user_id""",
    "remove_flagged": f"SELECT user_id, part, field, coalesce(string_agg('s' || event_id, ' ' ORDER BY event_id) FILTER (k < 2), '') AS text FROM ({_VERDICTS}) GROUP BY user_id, part, field",
    "mention_rows": r"""WITH m AS (SELECT lower(n_name) AS raw, 'S_nation' AS source, n_nationkey::VARCHAR AS id, 'nation' AS type, 'kind: x' AS c, 0 AS r, n_nationkey AS p FROM nation
        UNION ALL SELECT lower(r_name), 'S_region', r_regionkey::VARCHAR, 'region', '', 1, r_regionkey FROM region),
        e AS (SELECT *, regexp_replace(regexp_replace(raw, '\bnation_1\b', 'first nation', 'g'), '\bnation\b', 'NATION', 'g') AS text FROM m)
        SELECT lower(text) AS key, text, raw AS text_raw, source, id AS source_row_id, type, c AS source_text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY r, p) AS nth FROM e) WHERE nth = 1""",
    "quantities": """SELECT o_orderkey, array_to_string(list_sort(list_distinct([(o_orderkey % 37) || ' mg', (o_custkey % 9) || ' day', o_orderkey || ' time'])), ',') AS found FROM orders""",
    "number_precision": r"""WITH q AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^0-9 ]', ' ', 'g'), '\d+'), lambda x: x::DOUBLE)) AS q FROM documents)
        SELECT doc_id, CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE round(1 - len(list_filter(q, lambda x: NOT list_contains([0, 5, 10, 15, 20, 25, 30, 35, 40, 45]::DOUBLE[], x))) / len(q), 6) END AS precision FROM q""",
    "key_point_coverage": rf"""SELECT item_id, round((regexp_matches(t, '\bthe(?:s|es)?\b|\bder(?:s|es)?\b')::INT + regexp_matches(t, '\bmentation\w*\b')::INT + regexp_matches(t, '\bque(?:s|es)? la(?:s|es)?\b|\bto(?:s|es)? the(?:s|es)?\b')::INT) / 3, 6) AS coverage
        FROM (SELECT item_id, {_NORM} AS t FROM benchmark)""",
    "readability": f"""SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN 1.0::DOUBLE ELSE round(1 - len(list_filter(p, lambda x: {_N.format('x')} > 20)) / len(p), 6) END AS score
        FROM (SELECT conv_id, turn, {_PIECES} AS p FROM conversations)""",
    "silent_zero": rf"""SELECT conv_id, turn, CASE WHEN n < 3 OR (n < 60 AND regexp_matches(text, '(?i)\bI\s+(?:can(?:no|''|’)?t|can not|am unable|won(?:''|’)t)\b|\bI[''’]m (?:not able|unable)\b')) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score
        FROM (SELECT *, {_N.format('text')} AS n FROM conversations)""",
    "weighted_score": "SELECT conv_id, turn, round((length(text) % 5 / 4 * 2 + turn % 3 / 2 + conv_id % 2 + 1) / 5, 6) AS score FROM conversations",
    "verdict_decide": """WITH b AS (SELECT range AS id, range & 1 > 0 AS med, range & 2 > 0 AS fact, range & 4 > 0 AS con, range & 8 > 0 AS st, range & 16 > 0 AS same, range & 32 > 0 AS every, range & 64 > 0 AS women, range & 128 > 0 AS sw, range & 256 > 0 AS added FROM range(512))
        SELECT id, CASE WHEN NOT med THEN 'NO_CLAIM' WHEN NOT fact THEN 'NOT_SUPPORTED' WHEN con THEN 'CONTRADICTED' WHEN NOT st OR added OR NOT (every OR same) THEN 'NOT_SUPPORTED'
          WHEN NOT every AND NOT sw THEN 'NOT_SUPPORTED' ELSE 'SUPPORTED' END AS label FROM b""",
}
