"""Queries over mining, merging, linking and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import linking, merge, mining, order, relations
from corpusloom.plans._tables import read

SUFFIX = r"(?:^|[ \n])([A-Z][a-z]+(?:ing|tion|ment|keit|ung))[ .,]"
PHRASE = r"[ \n]((?:[a-z]+ ){1,2}(?:the|of|der|die|la|de))[ .,]"
TYPES = {"econ": "economy class", "std": "standard class"}


def phrase_mining(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = mining.mine(docs, "doc_id", F.col("text"), PHRASE, key=F.lower, clean=lambda s: T.squeeze(s), valid=lambda s: F.length(s).between(5, 80), group=1)
    return found.select("key", "span", "first_block", "freq")


def suffix_mining(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(read(spark, d, "documents"), "doc_id", F.col("text"), SUFFIX, key=F.lower, valid=lambda s: F.length(s) >= 4, group=1)


def sentence_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.where(F.length("sentence").between(20, 600)).select(F.substring(F.lower("sentence"), 1, 120).alias("key"), "doc_id", "pos", "sentence")
    return order.first_wins(rows, ["key"], ["doc_id", "pos"]).select(F.md5("key").alias("key"), "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("sentence"))


def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", T.norm_key(F.col("p_name")).alias("key"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), "p_brand", "p_type")
    found = merge.merge(p, ["key"], "id", "name", ["p_brand", "p_type"], "p_partkey")
    return found.select("key", "id", "name", F.col("p_brand").alias("brands"), F.col("p_type").alias("types"), "n", F.col("first_position").alias("first_part"))


def scheme_merge(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" | ", F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("scheme"))
    return p.groupBy("p_brand").agg(merge.joined_schemes("scheme", "p_partkey").alias("schemes"))


def stage_key(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    scheme = F.when(F.col("p_size") % 2 == 0, "NYHA").otherwise("ACC/AHA")
    level = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("L "), (F.col("p_size") % 4).cast("string")))
    return p.select("p_partkey", merge.stage_key(scheme, level, F.when(F.col("p_size") % 10 == 0, F.col("p_name")), F.lit("stage_none")).alias("key"))


def grouping_keys(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    given = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("drug_txt_"), F.col("p_type"))).otherwise("")
    canonical = merge.canonical_id("drug", given, F.col("p_name"))
    return p.select("p_partkey", canonical.alias("id"), merge.grouping_key("drug", canonical, {"economy": "low cost"}, {"_bolt": "_screw"}).alias("key"))


def vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", T.letters_key(F.col("p_name")).alias("key"))
    vocabulary = p.groupBy("key").agg(F.min("p_partkey").alias("id"))
    return p.join(vocabulary, "key", "left").select("p_partkey", "id")


def semi_join_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


def anti_join_new(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Each text once, as the linking driver has it."""
    rows = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return rows.groupBy("text").agg(F.min("p_partkey").alias("mention")).select("mention", "text")


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "part").select(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lower(F.regexp_replace("p_brand", "#", " "))).alias("label"), "p_partkey")
    return c.groupBy("label").agg(F.min("p_partkey").alias("concept"))


def candidate_rarest(spark: SparkSession, d: str) -> DataFrame:
    found = linking.candidates(_mentions(spark, d), "mention", "text", _concepts(spark, d), "concept", "label", 1_000_000)
    return found.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.min("concept").alias("first_concept"), F.sum("concept").alias("sum_concepts"))


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m, c = _mentions(spark, d), _concepts(spark, d)
    pairs = linking.candidates(m, "mention", "text", c, "concept", "label").join(m, "mention").join(c, "concept")
    return m, pairs


def link_similarity(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _linked(spark, d)
    return linking.ranked(pairs, "mention", "concept", linking.similarity(F.col("text"), F.col("label")))


def link_status(spark: SparkSession, d: str) -> DataFrame:
    m, pairs = _linked(spark, d)
    best = linking.ranked(pairs, "mention", "concept", T.jaccard(F.array_distinct(T.tokens(F.col("text"))), F.array_distinct(T.tokens(F.col("label")))))
    found = linking.statuses(m, "mention", best, "concept", 0.7)
    return found.select("mention", F.col("n_candidates").cast("long").alias("n_candidates"), "final", "status")


def bridge_links(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    links = p.select("p_partkey", "p_name", F.upper("p_type").alias("label"))
    first = lambda c, name: p.groupBy(c).agg(F.min("p_partkey").alias("entity")).select("entity", name.alias("name"))
    entities = first("p_name", F.concat(F.lit(" "), F.col("p_name"))).unionByName(first("p_type", F.lower("p_type")).withColumn("entity", -F.col("entity") - 1))
    return linking.bridges(links, ["p_name", "label"], entities, "entity", "name", ["p_partkey"])


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.passages(F.col("text"))).alias("pos", "text"))
    return rows.select(F.concat_ws(":", "doc_id", "pos").alias("sentence"), "text")


def passages_two_entities(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "benchmark").select(F.col("item_id").alias("entity"), F.get(F.filter(T.tokens(F.col("text"), 1), lambda t: F.length(t).between(4, 6)), F.lit(0)).alias("name"))
    found = relations.passages(_sentences(spark, d), "sentence", "text", names.where("name is not null"), "entity", "name")
    return found.select("sentence", F.array_join("entities", ",").alias("entities"), F.md5("text").alias("digest"))


def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relations.holding(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "benchmark"), "item_id", "text")


def resolve_endpoint(spark: SparkSession, d: str) -> DataFrame:
    ends = read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lit("x"))).alias("endpoint")).distinct()
    names = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    return relations.resolve(ends, "endpoint", names, "p_name", "pos")


def jaccard_top1(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("page"))
    items = read(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 40).alias("page"))
    return relations.best_overlap(docs, "doc_id", "text", items, "item_id", "text", ["page"])


QUERIES = {f.__name__: f for f in (
    phrase_mining, suffix_mining, sentence_dedup_first, entity_merge, scheme_merge, stage_key, grouping_keys, vocab_lookup, semi_join_filter, anti_join_new,
    candidate_rarest, link_similarity, link_status, bridge_links, passages_two_entities, containment_pairs, resolve_endpoint, jaccard_top1)}

_S = r"[ \t\n\v\f\r]"
_SQ = f"trim(regexp_replace({{}}, '{_S}+', ' ', 'g'))"
_SENT = rf"""SELECT doc_id, s[i] AS sentence, i - 1 AS pos FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace({_SQ.format('text')}, '([.!?;]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents))"""
_PASS = rf"""SELECT doc_id || ':' || (i - 1) AS sentence, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace({_SQ.format('text')}, '([.!?]) +([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x) > 30) AS s FROM documents))"""
_TOK = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) >= {})"
_MENTIONS = "SELECT min(p_partkey) AS mention, text FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) AS text FROM part) GROUP BY text"
_CONCEPTS = "SELECT label, min(p_partkey) AS concept FROM (SELECT lower(p_type) || ' ' || p_name || ' ' || lower(replace(p_brand, '#', ' ')) AS label, p_partkey FROM part) GROUP BY label"
_CANDIDATES = f"""m AS ({_MENTIONS}), c AS ({_CONCEPTS}),
  own AS (SELECT concept, unnest(list_distinct({_TOK.format('label', 2)})) AS token FROM c),
  df AS (SELECT token, count(*) AS df FROM own GROUP BY token),
  said AS (SELECT mention, t[i] AS token, i FROM (SELECT mention, {_TOK.format('text', 2)} AS t, unnest(range(1, len({_TOK.format('text', 2)}) + 1)) AS i FROM m)),
  two AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY df, i) AS nth, count(*) OVER (PARTITION BY mention) AS known FROM said JOIN df USING (token)),
  hits AS (SELECT mention, concept, count(*) AS held, first(known) AS known FROM two JOIN own USING (token) WHERE nth <= 2 GROUP BY ALL),
  pairs AS (SELECT mention, concept FROM (SELECT *, bool_or(held >= least(known, 2)) OVER (PARTITION BY mention) AS every FROM hits) WHERE held >= least(known, 2) OR NOT every)"""


def _mined(pattern: str, group: int, valid: str, clean: str = "x") -> str:
    return rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}', {group}) AS a FROM documents),
        h AS (SELECT doc_id, i, {clean.replace('x', 'a[i]')} AS span FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM m)),
        k AS (SELECT doc_id, i, span, lower(span) AS key FROM h WHERE {valid})
        SELECT key, first(span ORDER BY doc_id, i) AS span, min(doc_id) AS first_block, count(DISTINCT doc_id) AS freq FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 2"""


def _joined(value: str, by: str) -> str:
    """Distinct values in the order of first sight."""
    return f"(SELECT p.key, string_agg(v, ' | ' ORDER BY f) AS {by} FROM (SELECT key, {value} AS v, min(p_partkey) AS f FROM p GROUP BY ALL) p GROUP BY p.key)"


ORACLES = {
    "phrase_mining": _mined(PHRASE, 1, "length(span) BETWEEN 5 AND 80"),
    "suffix_mining": _mined(SUFFIX, 1, "length(span) >= 4"),
    "sentence_dedup_first": f"""SELECT md5(key) AS key, doc_id, pos, md5(sentence) AS sentence FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM (SELECT *, substring(lower(sentence), 1, 120) AS key FROM ({_SENT}) WHERE length(sentence) BETWEEN 20 AND 600)) WHERE r = 1""",
    "entity_merge": f"""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS key, 'part_' || p_partkey AS id, p_name || ' ' || p_type AS name, p_brand, p_type FROM part)
        SELECT key, first(id ORDER BY length(id), p_partkey) AS id, first(name ORDER BY length(name) DESC, p_partkey) AS name, any_value(brands) AS brands, any_value(types) AS types, count(*) AS n, min(p_partkey) AS first_part
        FROM p JOIN {_joined('p_brand', 'brands')} b USING (key) JOIN {_joined('p_type', 'types')} t USING (key) GROUP BY key""",
    "scheme_merge": """WITH p AS (SELECT p_brand, p_partkey, concat_ws(' | ', CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_type END, CASE WHEN p_size % 2 = 0 THEN p_type END) AS scheme FROM part),
        u AS (SELECT p_brand, p_partkey, s[i] AS part, i FROM (SELECT *, string_split(scheme, '|') AS s, unnest(range(1, len(string_split(scheme, '|')) + 1)) AS i FROM p)),
        f AS (SELECT p_brand, trim(part) AS part, min((p_partkey, i)) AS f FROM u WHERE trim(part) <> '' GROUP BY ALL),
        k AS (SELECT *, count(CASE WHEN lower(part) <> 'unknown' THEN 1 END) OVER (PARTITION BY p_brand) AS known FROM f)
        SELECT p_brand, string_agg(part, ' | ' ORDER BY f) AS schemes FROM k WHERE known = 0 OR lower(part) <> 'unknown' GROUP BY p_brand""",
    "stage_key": r"""SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'stage_' || CASE WHEN p_size % 2 = 0 THEN 'nyha_' ELSE '' END || 'l_' || (p_size % 4)
        WHEN p_size % 10 = 0 THEN 'stage_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'stage_none' END AS key FROM part""",
    "grouping_keys": r"""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'drug_' || p_type ELSE 'drug_' || trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_') END AS id FROM part),
        k AS (SELECT *, trim(regexp_replace(lower(id[6:]), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM c)
        SELECT p_partkey, id, 'drug_' || CASE WHEN replace(k, '_', '') = 'economy' THEN 'low_cost' WHEN ends_with(k, '_bolt') THEN k[:-6] || '_screw' ELSE k END AS key FROM k""",
    "vocab_lookup": r"SELECT p_partkey, min(p_partkey) OVER (PARTITION BY regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')) AS id FROM part",
    "semi_join_filter": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_join_new": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "candidate_rarest": f"WITH {_CANDIDATES} SELECT mention, count(*) AS n, min(concept) AS first_concept, sum(concept)::BIGINT AS sum_concepts FROM pairs GROUP BY mention",
    "link_status": f"""WITH {_CANDIDATES},
        j AS (SELECT mention, concept, list_distinct({_TOK.format('m.text', 2)}) AS a, list_distinct({_TOK.format('c.label', 2)}) AS b FROM pairs JOIN m USING (mention) JOIN c USING (concept)),
        s AS (SELECT mention, concept, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS raw FROM j),
        r AS (SELECT mention, concept, round(raw, 4) AS sim, row_number() OVER (PARTITION BY mention ORDER BY round(raw, 4) DESC, concept) AS rank FROM s WHERE raw > 0.25),
        b AS (SELECT mention, count(*) AS n, max(CASE WHEN rank = 1 THEN sim END) AS sim, max(CASE WHEN rank = 1 THEN concept END) AS top FROM r WHERE rank <= 15 GROUP BY mention)
        SELECT mention, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 OR sim >= 0.7 THEN top END AS final,
          CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 OR sim >= 0.7 THEN 'direct' ELSE 'needs_disambiguation' END AS status FROM m LEFT JOIN b USING (mention)""",
    "bridge_links": """WITH l AS (SELECT p_partkey, lower(p_name) AS k FROM part UNION SELECT p_partkey, lower(p_type) FROM part),
        e AS (SELECT min(p_partkey) AS entity, lower(p_name) AS k FROM part GROUP BY p_name UNION ALL SELECT -min(p_partkey) - 1, lower(p_type) FROM part GROUP BY p_type)
        SELECT DISTINCT l.p_partkey, entity FROM l JOIN e USING (k) WHERE k <> ''""",
    "passages_two_entities": rf"""WITH s AS ({_PASS}),
        l AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u FROM s),
        c AS (SELECT sentence, text, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS hay FROM l
          WHERE NOT (length(text) - length(replace(text, '|', '')) >= 4 OR (n >= 10 AND u / n > 0.75 AND len(string_split({_SQ.format('text')}, ' ')) <= 10))),
        e AS (SELECT item_id AS entity, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) BETWEEN 4 AND 6)[1] AS name FROM benchmark),
        h AS (SELECT sentence, text, entity FROM c JOIN e ON contains(hay, ' ' || name || ' ') WHERE name IS NOT NULL)
        SELECT sentence, string_agg(entity::VARCHAR, ',' ORDER BY entity) AS entities, md5(substring(any_value(text), 1, 1500)) AS digest FROM h GROUP BY sentence HAVING count(*) >= 2""",
    "containment_pairs": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "resolve_endpoint": """WITH e AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE lower(p_type) || ' ' || p_name || ' x' END AS endpoint FROM part),
        n AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY p_name),
        x AS (SELECT endpoint, arg_min(name, pos) AS name, 'exact' AS how FROM e JOIN n ON lower(endpoint) = lower(name) GROUP BY endpoint),
        y AS (SELECT endpoint, arg_min(name, pos) AS name, 'part' AS how FROM e JOIN n ON contains(lower(endpoint), lower(name)) OR contains(lower(name), lower(endpoint)) WHERE endpoint NOT IN (SELECT endpoint FROM x) GROUP BY endpoint)
        SELECT * FROM x UNION ALL SELECT * FROM y""",
    "jaccard_top1": f"""WITH d AS (SELECT doc_id, doc_id % 40 AS page, list_distinct({_TOK.format('text', 3)}) AS a FROM documents), b AS (SELECT item_id, item_id % 40 AS page, list_distinct({_TOK.format('text', 3)}) AS b FROM benchmark),
        j AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM d JOIN b USING (page)),
        s AS (SELECT doc_id, item_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE round(i / (na + nb - i), 6) END AS score FROM j)
        SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s WHERE score >= 0.08) WHERE r = 1""",
}
