"""Queries over retrieval, order, triples, layout and page scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import roles
from corpusloom.functions import text as T
from corpusloom.operators import graph, layout, order, retrieval
from corpusloom.plans._tables import read
from corpusloom.sources import pages as scan

BASE = "http://example.org/g"
TOP = 10


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.bm25(read(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), read(spark, d, "benchmark"), "item_id", T.tokens(F.col("text")), TOP)
    return found.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def inverted_index_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequency(read(spark, d, "documents"), "doc_id", T.tokens(F.col("text")))


def token_tf_stats(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.postings(read(spark, d, "documents"), "doc_id", T.tokens(F.col("text")))
    return p.groupBy("doc_id").agg(F.max("len").cast("long").alias("len"), F.max("tf").alias("max_tf"), F.count(F.lit(1)).alias("n_distinct"))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    table = {"the": "thesaurus word", "la": "article", "of": "genitive"}
    return read(spark, d, "benchmark").select("item_id", F.array_join(retrieval.expanded(T.tokens(F.col("text")), table), " ").alias("words"))


def first_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    keys, at = ["user_id", "event_type"], ["ts", "event_id"]
    a = order.first_wins(e, keys, at).select(*keys, F.col("event_id").alias("first_id"), F.col("value").alias("first_value"))
    b = order.last_wins(e, keys, at).select(*keys, F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return a.join(b, keys)


def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return order.mode_first_seen(read(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    said = F.when(F.col("event_type") == "signup", F.col("value"))
    return e.select("event_id", order.carry_forward(said, ["user_id"], ["ts", "event_id"]).alias("last_signup"))


def island_cutoff(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").withColumn("part", F.floor(F.col("doc_id") / 500))
    return order.islands(rows, ["part"], "doc_id", F.col("toxic") == 1, 2)


def column_split_gap(spark: SparkSession, d: str) -> DataFrame:
    found = layout.largest_gap(read(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice")
    return found.select("l_orderkey", "n", F.round("gap", 4).alias("gap"), F.round("boundary", 4).alias("boundary"))


def nearest_prior(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    at = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.select("event_id", "event_type", F.last(click, ignorenulls=True).over(at).alias("click_id"))
    return rows.where("event_type = 'purchase' and click_id is not null").select("event_id", "click_id")


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    r, n, s = (read(spark, d, t) for t in ("region", "nation", "supplier"))
    node = lambda kind, c: graph.iri(BASE, kind, F.col(c))
    return [
        graph.triples(r, node("region", "r_regionkey"), {"name": F.col("r_name")}, {}, BASE),
        graph.triples(n, node("nation", "n_nationkey"), {"name": F.col("n_name")}, {"inRegion": node("region", "n_regionkey")}, BASE),
        graph.triples(s, node("supplier", "s_suppkey"), {"name": F.col("s_name")}, {"inNation": node("nation", "s_nationkey")}, BASE),
    ]


def triples_map(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged(*_tables(spark, d))


def triples_union(spark: SparkSession, d: str) -> DataFrame:
    parts = _tables(spark, d)
    return graph.merged(*parts, parts[1], parts[0]).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def triples_join(spark: SparkSession, d: str) -> DataFrame:
    g = graph.merged(*_tables(spark, d))
    has = lambda p: g.where(F.col("p") == f"{BASE}#{p}")
    a = has("inNation").select("s", F.col("o").alias("nation")).join(has("name").select(F.col("s").alias("nation"), F.col("o").alias("name")), "nation")
    a = a.join(has("inRegion").select(F.col("s").alias("nation"), F.col("o").alias("region")), "nation").join(has("name").select(F.col("s").alias("region"), F.col("o").alias("region_name")), "region")
    return a.groupBy("region_name").agg(F.count(F.lit(1)).alias("n_suppliers"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("nations"))


def ntriples_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(graph.iri(BASE, "doc", F.col("doc_id")).alias("s"), F.lit(f"{BASE}#text").alias("p"), F.col("text").alias("o"), F.lit(False).alias("o_is_iri"))
    back = graph.parsed(graph.rendered(docs.unionByName(triples_map(spark, d))))
    return back.select("s", "p", F.md5("o").alias("digest"), "o_is_iri")


def dictionary_last_wins(spark: SparkSession, d: str) -> DataFrame:
    names = lambda t, c, rank: read(spark, d, t).select(F.lower(c).alias("name"), F.lit(t).alias("kind"), F.lit(rank).alias("rank"))
    rows = names("region", "r_name", 0).unionByName(names("nation", "n_name", 1)).unionByName(names("supplier", "s_name", 2)).unionByName(names("region", "r_name", 3))
    return rows.groupBy("name").agg(F.max_by("kind", "rank").alias("kind"), F.max("rank").alias("rank"), F.min("rank").alias("place"))


def default_row_cross(spark: SparkSession, d: str) -> DataFrame:
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    pairs = r.select("r_name").crossJoin(n.select("n_name"))  # one table of fixed rows with another
    base = spark.range(1).select(F.lit("none").alias("default"))
    missing = base.join(read(spark, d, "nation").where("n_nationkey < 0").select("n_name"), F.lit(True), "left")
    return pairs.unionByName(missing.select(F.col("default").alias("r_name"), F.coalesce("n_name", F.lit("")).alias("n_name")))


def array_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    second = F.try_element_at("a", F.lit(2))
    return lines.select("l_orderkey", second["l_partkey"].alias("second_part"), F.get(F.filter("a", lambda x: x["l_linenumber"] == 3), 0)["l_suppkey"].alias("third_supplier"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("user_id").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n_k"))


def url_html_scan(spark: SparkSession, d: str) -> DataFrame:
    p = scan.scanned(read(spark, d, "pages"))
    return p.select("page_id", "host", "title", F.array_join("headers", "|").alias("headers"), F.size("links").cast("long").alias("n_links"), "caption")


def role_classify(spark: SparkSession, d: str) -> DataFrame:
    p = scan.scanned(read(spark, d, "pages"))
    # the first letters of invented words stand for clinical ones, so that roles do occur
    caption = F.concat(F.col("caption"), F.when(F.col("page_id") % 5 == 0, " Table 1 causes").when(F.col("page_id") % 5 == 1, " Commonly used drugs").when(F.col("page_id") % 5 == 2, " Quality of care").when(F.col("page_id") % 5 == 3, " Appendix").otherwise(""))
    return p.select("page_id", roles.classify(F.col("headers"), caption).alias("role"), roles.generic_headers(F.col("headers")).alias("generic"))


def role_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    found = role_classify(spark, d).groupBy(F.coalesce("role", F.lit("unmatched")).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(total).select("role", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))  # one row


QUERIES = {f.__name__: f for f in (
    bm25_topk, inverted_index_df, token_tf_stats, query_expansion, first_last_wins, mode_first_seen, carry_forward, island_cutoff, column_split_gap, nearest_prior,
    triples_map, triples_union, triples_join, ntriples_roundtrip, dictionary_last_wins, default_row_cross, array_lookup, json_extract, url_html_scan, role_classify, role_coverage_report)}

_TOK = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) >= 2)"
_TRIPLES = f"""
  SELECT '{BASE}/region/' || r_regionkey AS s, '{BASE}#name' AS p, r_name AS o, false AS o_is_iri FROM region
  UNION SELECT '{BASE}/nation/' || n_nationkey, '{BASE}#name', n_name, false FROM nation
  UNION SELECT '{BASE}/nation/' || n_nationkey, '{BASE}#inRegion', '{BASE}/region/' || n_regionkey, true FROM nation
  UNION SELECT '{BASE}/supplier/' || s_suppkey, '{BASE}#name', s_name, false FROM supplier
  UNION SELECT '{BASE}/supplier/' || s_suppkey, '{BASE}#inNation', '{BASE}/nation/' || s_nationkey, true FROM supplier"""
_PAGES = r"""
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) AS headers,
    regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS links, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS caption FROM pages"""
_ROLE = rf"""
  SELECT page_id, h, cap, c2, CASE
    WHEN cap LIKE '%reviewer%' OR cap LIKE '%committee%' OR cap LIKE '%abbreviation%' OR cap LIKE '%appendix%' OR cap LIKE '%author relationship%' OR cap LIKE '%disclosure%' OR cap LIKE '%writing group%' THEN NULL
    WHEN coalesce(h[1], '') LIKE '%reviewer%' OR coalesce(h[1], '') LIKE '%writing committee%' THEN NULL
    WHEN (starts_with(coalesce(h[1], ''), 'recommendation') AND length(h[1]) > 30) OR (len(list_filter(h, lambda x: contains(x, 'cor'))) > 0 AND len(list_filter(h, lambda x: contains(x, 'loe'))) > 0)
      OR (len(list_filter(h, lambda x: starts_with(x, 'class'))) > 0 AND len(list_filter(h, lambda x: starts_with(x, 'level'))) > 0)
      OR (len(list_filter(h, lambda x: contains(x, 'recommendation'))) > 0 AND len(list_filter(h, lambda x: contains(x, 'cor') OR contains(x, 'loe') OR starts_with(x, 'class') OR starts_with(x, 'level'))) > 0)
      OR (contains(cap, 'recommendation') AND (contains(cap, 'cor') OR contains(cap, 'loe') OR contains(cap, 'class') OR contains(cap, 'level'))) THEN 'recommendation'
    WHEN (len(list_filter(h, lambda x: contains(x, 'drug') OR contains(x, 'agent') OR contains(x, 'medication'))) > 0 AND len(list_filter(h, lambda x: contains(x, 'dose') OR contains(x, 'daily') OR contains(x, 'dosing') OR contains(x, 'infusion') OR contains(x, 'rate'))) > 0)
      OR ((contains(cap, 'drug') OR contains(cap, 'diuretic') OR contains(cap, 'medication')) AND (contains(cap, 'dose')))
      OR (contains(cap, 'commonly used') AND (contains(cap, 'drug') OR contains(cap, 'medication'))) THEN 'drug_dosing'
    WHEN contains(cap, 'harm') OR contains(cap, 'exacerbat') OR contains(cap, 'may cause') OR contains(cap, 'worsen') THEN 'harmful_drug'
    WHEN contains(cap, 'inotropic') OR contains(cap, 'intravenous') THEN 'inotropic_agent'
    WHEN contains(cap, 'stage') AND (contains(cap, 'definition') OR contains(cap, 'criteria')) THEN 'stage'
    WHEN len(list_filter(h, lambda x: starts_with(x, 'type of') OR contains(x, 'phenotype') OR contains(x, 'lvef'))) > 0 THEN 'phenotype'
    WHEN NOT contains(cap, 'natriuretic') AND (contains(cap, 'cause') OR contains(cap, 'etiolog') OR len(list_filter(h, lambda x: contains(x, 'cause') OR contains(x, 'etiology'))) > 0) THEN 'cause'
    WHEN contains(cap, 'performance') OR contains(cap, 'quality') THEN 'performance_measure'
    END AS role FROM (SELECT page_id, list_transform(headers, lambda x: trim(lower(x))) AS h, lower(c2) AS cap, c2 FROM (SELECT *, caption || CASE page_id % 5 WHEN 0 THEN ' Table 1 causes' WHEN 1 THEN ' Commonly used drugs' WHEN 2 THEN ' Quality of care' WHEN 3 THEN ' Appendix' ELSE '' END AS c2 FROM ({_PAGES})))"""

ORACLES = {
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
        st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM d),
        tf AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM d) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, round(sum(times * pow(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 2) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 4) AS score
          FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY ALL)
        SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}""",
    "inverted_index_df": f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS token FROM documents) GROUP BY token",
    "token_tf_stats": f"""WITH t AS (SELECT doc_id, token, len, count(*) AS tf FROM (SELECT doc_id, len({_TOK.format('text')}) AS len, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY ALL)
        SELECT doc_id, max(len) AS len, max(tf) AS max_tf, count(*) AS n_distinct FROM t GROUP BY doc_id""",
    "query_expansion": f"""SELECT item_id, array_to_string(list_concat(t, flatten(list_transform(t, lambda w: CASE w WHEN 'the' THEN ['thesauru', 'word'] WHEN 'la' THEN ['article'] WHEN 'of' THEN ['genitive'] ELSE [] END))), ' ') AS words
        FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark)""".replace("['thesauru', 'word']", "['thesauru', 'word']"),
    "first_last_wins": """SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS first_id, first(value ORDER BY ts, event_id) AS first_value,
        last(event_id ORDER BY ts, event_id) AS last_id, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY ALL""",
    "mode_first_seen": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS t, arg_min(event_id, ts) AS e FROM events GROUP BY ALL)
        SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t, e) AS r FROM c) WHERE r = 1""",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events",
    "island_cutoff": """WITH r AS (SELECT doc_id, toxic, doc_id // 500 AS part, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS i FROM labels),
        k AS (SELECT *, i - row_number() OVER (PARTITION BY part ORDER BY doc_id) AS isle FROM r WHERE toxic = 1)
        SELECT part, min(doc_id) AS island_start, max(doc_id) AS island_end, count(*) AS n FROM k GROUP BY part, isle HAVING count(*) >= 2""",
    "column_split_gap": """WITH s AS (SELECT l_orderkey, l_extendedprice AS v, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) - l_extendedprice AS g FROM lineitem),
        b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g DESC NULLS LAST, v) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
        SELECT l_orderkey, n, round(g, 4) AS gap, round(v + g / 2, 4) AS boundary FROM b WHERE r = 1""".replace("round(v + g / 2, 4) AS boundary", "CASE WHEN g IS NOT NULL THEN round(v + g / 2, 4) END AS boundary"),
    "nearest_prior": """WITH w AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events)
        SELECT event_id, click_id FROM w WHERE event_type = 'purchase' AND click_id IS NOT NULL""",
    "triples_map": _TRIPLES,
    "triples_union": f"SELECT p, count(*) AS n FROM ({_TRIPLES}) GROUP BY p",
    "triples_join": """SELECT r_name AS region_name, count(*) AS n_suppliers, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "ntriples_roundtrip": f"SELECT s, p, md5(o) AS digest, o_is_iri FROM ({_TRIPLES} UNION ALL SELECT '{BASE}/doc/' || doc_id, '{BASE}#text', text, false FROM documents)",
    "dictionary_last_wins": """WITH n AS (SELECT lower(r_name) AS name, 'region' AS kind, 0 AS rank FROM region UNION ALL SELECT lower(n_name), 'nation', 1 FROM nation
        UNION ALL SELECT lower(s_name), 'supplier', 2 FROM supplier UNION ALL SELECT lower(r_name), 'region', 3 FROM region)
        SELECT name, arg_max(kind, rank) AS kind, max(rank) AS rank, min(rank) AS place FROM n GROUP BY name""",
    "default_row_cross": "SELECT r_name, n_name FROM region, nation UNION ALL SELECT 'none', ''",
    "array_lookup": """WITH a AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, a[2].p AS second_part, list_filter(a, lambda x: x.n = 3)[1].s AS third_supplier FROM a""",
    "json_extract": "SELECT user_id, sum(k)::BIGINT AS sum_k, count(k) AS n_k FROM (SELECT user_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY user_id",
    "url_html_scan": f"SELECT page_id, host, title, array_to_string(headers, '|') AS headers, len(links) AS n_links, caption FROM ({_PAGES})",
    "role_classify": f"SELECT page_id, role, len(h) > 0 AND len(list_filter(h, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 AS generic FROM ({_ROLE})",
    "role_coverage_report": f"SELECT role, n, round(n * 100.0 / sum(n) OVER (), 1)::DOUBLE AS pct FROM (SELECT coalesce(role, 'unmatched') AS role, count(*) AS n FROM ({_ROLE}) GROUP BY ALL)",
}
