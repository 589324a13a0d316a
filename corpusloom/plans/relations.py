"""Queries over relation tables: who is treated, harmed, evaluated, caused, and where it is said.

Relations are made of all lineitems, each one with its order, customer and
part: names of parts are drugs, nations conditions, market segments therapies,
event types harms, order priorities assessments, regions causes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import linking, relations, storyboard
from corpusloom.plans import entities as entity_plans
from corpusloom.plans._tables import read

HARMS = ("view", "error", "purchase", "click", "signup")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    of = lambda table, column, kind, rank: read(spark, d, table).groupBy(F.col(column).alias("name")).agg(F.lit(rank).alias("rank")).select(F.concat_ws(":", F.lit(kind), "name").alias("id"), F.lit(kind).alias("kind"), "name", F.concat_ws(" ", "rank", "name").alias("position"))
    parts = (("part", "p_name", "Drug", 0), ("nation", "n_name", "Condition", 1), ("customer", "c_mktsegment", "Therapy", 2), ("events", "event_type", "AdverseEvent", 3), ("orders", "o_orderpriority", "Assessment", 4), ("region", "r_name", "Cause", 5))
    out = of(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(of(*p))
    return out


def _relations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    odd = F.col("l_suppkey") % 2 == 1
    harm = F.element_at(F.array(*map(F.lit, HARMS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    nowhere = F.when(F.col("l_suppkey") % 5 == 0, "##none##").otherwise(F.col("n_name"))
    end = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"))
    part, nation, segment = end(F.lower("p_name"), "Drug"), end(nowhere, "Condition"), end(F.concat(F.lit(" "), "c_mktsegment"), "Therapy")
    relation = F.element_at(F.array(*map(F.lit, relations.RELATIONS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    kind = F.col("l_linenumber") % 4
    rows = rows.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("position"), relation.alias("relation"), (F.col("l_suppkey") % 50).cast("int").alias("page"),
        F.when(kind == 0, F.when(odd, part).otherwise(nation)).when(kind == 1, F.when(odd, part).otherwise(end(harm, "AdverseEvent"))).when(kind == 2, F.when(odd, nation).otherwise(segment)).otherwise(nation).alias("a"),
        F.when(kind == 0, F.when(odd, nation).otherwise(segment)).when(kind == 1, F.when(odd, end(harm, "AdverseEvent")).otherwise(part)).when(kind == 2, end(F.col("o_orderpriority"), "Assessment")).otherwise(end(F.col("r_name"), "Cause")).alias("b"),
        F.concat(F.lit("Here the "), "p_name", F.lit(" is named first of all. "), F.when(F.col("l_suppkey") % 3 == 0, F.lit("Then they stop. ")).otherwise(F.lit("and ")), F.lit("a "), harm, F.lit(" is seen by many of those who look on.")).alias("passage"))
    return rows.select("position", "relation", "page", "passage", F.col("a.name").alias("subject"), F.col("a.kind").alias("subject_type"), F.col("b.name").alias("object"), F.col("b.kind").alias("object_type"))


def _recommendations(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").join(read(spark, d, "part"), F.col("o_custkey") == F.col("p_partkey"))
    rec = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("rec_"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("rec_table_p"), (F.col("o_custkey") % 50).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string")))
    harm = F.element_at(F.array(*map(F.lit, HARMS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(rec.alias("rec_id"), F.col("o_orderkey").alias("position"), F.concat(F.lit("Give the "), "p_name", F.lit(" and see a "), harm, F.lit(" first")).alias("text"))


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return relations.relation_tables(_relations(spark, d), _entities(spark, d), _recommendations(spark, d), names)


def relation_treats(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, "S_treats")["S_treats"]


def relation_adverse_event(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, "S_drug_adverse_event")["S_drug_adverse_event"]


def relation_assessment(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, "S_condition_assessment")["S_condition_assessment"]


def relation_cause(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, "S_condition_cause")["S_condition_cause"]


def relation_binding(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d, "S_recommendation")["S_recommendation"]


def relation_report(spark: SparkSession, d: str) -> DataFrame:
    found = _tables(spark, d, "S_treats", "S_condition_assessment", "S_condition_cause")
    return relations.report(_recommendations(spark, d), _relations(spark, d), found)


def entity_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return relations.type_counts(_entities(spark, d))


def names_longest_first(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return p.select("p_brand", F.array_join(relations.longest_first(F.col("names")), ",").alias("names"))


def link_rates(spark: SparkSession, d: str) -> DataFrame:
    return linking.rates(entity_plans.link_status(spark, d))


def chosen_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each order's lines the facts that numbers pick, six at most."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    picks = F.transform("x", lambda y: (y["l_suppkey"] % 9).cast("int"))
    facts = F.transform("x", lambda y: F.concat_ws("/", y["l_linenumber"], y["l_partkey"]))
    return lines.select("l_orderkey", F.array_join(storyboard.chosen(picks, facts), ",").alias("facts"))


QUERIES = {f.__name__: f for f in (
    relation_treats, relation_adverse_event, relation_assessment, relation_cause, relation_binding, relation_report, entity_type_counts, names_longest_first, link_rates, chosen_facts)}

_R = """r AS (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, l_linenumber % 4 AS k, l_suppkey % 2 = 1 AS odd, l_suppkey % 5 = 0 AS lost, l_suppkey % 3 = 0 AS apart, l_suppkey % 50 AS page, p_name, n_name, r_name, c_mktsegment, o_orderpriority,
    ['view', 'error', 'purchase', 'click', 'signup'][l_partkey % 5 + 1] AS harm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
  dflt AS (SELECT 'Condition:' || min(n_name) AS c FROM nation),
  t AS (SELECT * FROM (SELECT *, 'Condition:' || n_name AS condition_id, CASE WHEN odd THEN '' ELSE 'Therapy:' || c_mktsegment END AS therapy_id, CASE WHEN odd THEN 'Drug:' || p_name ELSE '' END AS drug_id FROM r WHERE k = 0 AND NOT lost)
    QUALIFY row_number() OVER (PARTITION BY condition_id, therapy_id, drug_id ORDER BY pos) = 1),
  a AS (SELECT *, 'Drug:' || p_name AS drug_id, 'AdverseEvent:' || harm AS ae_id FROM r WHERE k = 1),
  e AS (SELECT DISTINCT CASE WHEN odd THEN 'Condition:' || n_name ELSE (SELECT c FROM dflt) END AS condition_id, 'Assessment:' || o_orderpriority AS assessment_id FROM r WHERE k = 2 AND NOT (odd AND lost)),
  c AS (SELECT DISTINCT 'Condition:' || n_name AS condition_id, 'Cause:' || r_name AS cause_id FROM r WHERE k = 3 AND NOT lost)"""
_TOK3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) >= 3))"
_RECS = "SELECT o_orderkey AS position, CASE WHEN o_orderkey % 7 = 0 THEN 'rec_' || o_orderkey ELSE 'rec_table_p' || o_custkey % 50 || '_' || o_orderkey END AS rec_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 50 END AS page, 'Give the ' || p_name || ' and see a ' || ['view', 'error', 'purchase', 'click', 'signup'][o_orderkey % 5 + 1] || ' first' AS text FROM orders JOIN part ON o_custkey = p_partkey"
#: A sentence that ends before a capital parts the two names; short names' tokens may still stand in both.
_ADVERSE = f"""s AS (SELECT *, 'Here the ' || p_name || ' is named first of all. ' || CASE WHEN apart THEN 'Then they stop. ' ELSE 'and ' END || 'a ' || harm || ' is seen by many of those who look on.' AS passage FROM a),
  good AS (SELECT * FROM s WHERE len(list_filter(list_filter(string_split(regexp_replace(passage, '([.!?]) +([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(x) > 30),
    lambda x: contains(lower(x), harm) AND (contains(lower(x), lower(p_name)) OR len(list_filter({_TOK3.format('p_name')}, lambda y: contains(lower(x), y))) > 0))) > 0)"""

ORACLES = {
    "relation_treats": f"WITH {_R} SELECT 'treats_step4_' || CASE WHEN odd THEN drug_id ELSE therapy_id END AS treats_id, condition_id, therapy_id, drug_id FROM t",
    "relation_adverse_event": f"WITH {_R}, {_ADVERSE} SELECT DISTINCT drug_id, ae_id FROM good",
    "relation_assessment": f"WITH {_R} SELECT * FROM e",
    "relation_cause": f"WITH {_R} SELECT * FROM c",
    "relation_binding": f"""WITH {_R}, {_ADVERSE},
        said AS (SELECT pos, page, 'Here the ' || p_name || ' is named first of all. ' || CASE WHEN apart THEN 'Then they stop. ' ELSE 'and ' END || 'a ' || harm || ' is seen by many of those who look on.' AS passage, condition_id, therapy_id, drug_id, '' AS ae_id,
            CASE WHEN odd THEN [p_name] ELSE [c_mktsegment] END AS names FROM t
          UNION ALL SELECT pos, page, passage, (SELECT c FROM dflt), '', drug_id, ae_id, [p_name, harm] FROM good),
        recs AS ({_RECS}),
        kinds AS (SELECT DISTINCT page, names FROM said),
        fits AS (SELECT page, names, rec_id, position, {_TOK3.format('text')} AS b FROM kinds JOIN recs USING (page)
          WHERE len(list_filter(names, lambda n: contains(lower(text), lower(n)) OR len(list_filter({_TOK3.format('n')}, lambda y: contains(lower(text), y))) > 0)) = len(names)),
        toks AS (SELECT *, {_TOK3.format('passage')} AS a FROM said),
        scored AS (SELECT pos, condition_id, therapy_id, drug_id, ae_id, rec_id, position, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS s FROM toks JOIN fits USING (page, names)),
        best AS (SELECT * FROM scored WHERE s >= 0.08 QUALIFY row_number() OVER (PARTITION BY pos, condition_id, therapy_id, drug_id, ae_id ORDER BY s DESC, position) = 1)
        SELECT rec_id, condition_id, therapy_id, drug_id, ae_id FROM best QUALIFY row_number() OVER (PARTITION BY rec_id, therapy_id, drug_id, ae_id ORDER BY pos) = 1""",
    "relation_report": f"""WITH {_R} SELECT 'passages' AS name, (SELECT count(*) FROM orders JOIN part ON o_custkey = p_partkey) AS n UNION ALL SELECT 'relations', count(*) FROM r UNION ALL SELECT 'S_treats', count(*) FROM t
        UNION ALL SELECT 'S_condition_assessment', count(*) FROM e UNION ALL SELECT 'S_condition_cause', count(*) FROM c""",
    "entity_type_counts": """SELECT 'Drug' AS kind, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'Condition', count(DISTINCT n_name) FROM nation UNION ALL SELECT 'Therapy', count(DISTINCT c_mktsegment) FROM customer
        UNION ALL SELECT 'AdverseEvent', count(DISTINCT event_type) FROM events UNION ALL SELECT 'Assessment', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'Cause', count(DISTINCT r_name) FROM region""",
    "names_longest_first": "SELECT p_brand, string_agg(p_name, ',' ORDER BY length(p_name) DESC, p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand",
    "link_rates": f"SELECT status, n, round(n / sum(n) OVER (), 4)::DOUBLE AS rate FROM (SELECT status, count(*) AS n FROM ({entity_plans.ORACLES['link_status']}) GROUP BY status)",
    "chosen_facts": """WITH l AS (SELECT l_orderkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber || '/' || l_partkey AS fact, l_suppkey % 9 AS pick FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        p AS (SELECT l_orderkey, pick, min(i) AS first FROM l WHERE pick BETWEEN 1 AND n GROUP BY ALL),
        q AS (SELECT p.l_orderkey, fact, row_number() OVER (PARTITION BY p.l_orderkey ORDER BY first) AS r, first FROM p JOIN l ON p.l_orderkey = l.l_orderkey AND p.pick = l.i)
        SELECT l_orderkey, coalesce(string_agg(fact, ',' ORDER BY first) FILTER (r <= 6), '') AS facts FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN q USING (l_orderkey) GROUP BY l_orderkey""",
}
