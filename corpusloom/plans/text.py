"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans._tables import read

ACRONYMS = {"ECONOMY": "economical make", "STANDARD": "standard make", "ANODIZED TIN": "tin with anodised skin", "TIN": "stannum", "BRASS": "copper and zinc"}


def whitespace_normalise(spark: SparkSession, d: str) -> DataFrame:
    t = T.squeeze(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def dehyphenate_merge(spark: SparkSession, d: str) -> DataFrame:
    t = T.join_lines(T.dehyphenate(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def acronym_expand(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", T.expand(F.col("p_type"), ACRONYMS).alias("in_order"), T.expand(F.col("p_type"), ACRONYMS, True).alias("longest_first"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


def norm_key(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", T.norm_key(F.concat_ws(" - ", "c_name", "c_mktsegment")).alias("key"), T.letters_key(F.col("c_name")).alias("letters"))


def edge_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("line"))
    return rows.select("doc_id", T.strip_edges(F.col("line")).alias("stripped"))


def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    t = T.merged_paragraphs(F.col("text"), "\n")
    return read(spark, d, "documents").select("doc_id", F.size(F.split(t, "\n")).cast("long").alias("n"), F.md5(t).alias("digest"))


def _counted(rows: DataFrame, c: str) -> DataFrame:
    return rows.select("doc_id", F.posexplode(c).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def sentence_split_a(spark: SparkSession, d: str) -> DataFrame:
    return _counted(read(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")), "s")


def sentence_split_b(spark: SparkSession, d: str) -> DataFrame:
    return _counted(read(spark, d, "documents").select("doc_id", T.passages(F.col("text")).alias("s")), "s")


def sentence_split_c(spark: SparkSession, d: str) -> DataFrame:
    return _counted(read(spark, d, "documents").select("doc_id", T.pieces(F.col("text")).alias("s")), "s")


def block_flags(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    t = F.col("t")
    return lines.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), T.is_url(t).alias("url"), T.is_contents(t).alias("contents"), T.is_artifact(t).alias("artifact"),
        T.is_metadata(t).alias("metadata"), T.is_reference_line(t).alias("reference"))


def caps_share(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents")
    n, up = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", "[^A-Z]", ""))
    return rows.select("doc_id", F.when(n > 0, F.round(up / n, 6)).alias("share"), T.count_of(F.col("text"), r"\|").cast("long").alias("pipes"))


def page_drop_flags(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import layout

    t = F.col("text")
    flag = layout.drop_page(t, F.split(t, "\n"), F.lit(100), F.lit(100))
    return read(spark, d, "documents").select("doc_id", flag.alias("dropped"))


def fact_gate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", T.is_fact(F.col("text")).alias("fact"), T.n_words(F.col("text")).cast("long").alias("n_words"))


def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.search_words(F.col("text")), " ").alias("words"))


QUERIES = {f.__name__: f for f in (
    whitespace_normalise, dehyphenate_merge, acronym_expand, slugify, norm_key, edge_strip, paragraph_merge, sentence_split_a, sentence_split_b, sentence_split_c,
    block_flags, caps_share, page_drop_flags, fact_gate, search_tokens)}

_S = r"[ \t\n\v\f\r]"
_SQUEEZE = f"trim(regexp_replace({{}}, '{_S}+', ' ', 'g'))"
_EDGE = "(?:and|or|with|for|of|in|the|a|an|to|is|are|was|were|by|at|on|from|due|{}that|which|who|also|but|not|as|if|than|into)"


def _edges(c: str) -> str:
    """The DuckDB form of `strip_edges`."""
    strip = rf"regexp_replace({{}}, '^{_S}+|{_S}+$', '', 'g')"
    for _ in range(5):
        c = strip.format(rf"regexp_replace({c}, '(?i){_S}+{_EDGE.format('has|have|had|')}{_S}*$', '')")
        c = strip.format(rf"regexp_replace({c}, '(?i)^{_EDGE.format('')}{_S}+', '')")
    return f"trim({c}, ' ,;:.()')"


def _expanded(c: str, keys: list[str]) -> str:
    for k in keys:
        c = rf"regexp_replace({c}, '\b{k}\b', '{ACRONYMS[k]}', 'g')"
    return c


_WORDS = f"CASE WHEN {_SQUEEZE.format('t')} = '' THEN 0 ELSE len(string_split({_SQUEEZE.format('t')}, ' ')) END"
_STOPS = "['" + "','".join(T.STOP) + "']"

ORACLES = {
    "whitespace_normalise": f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_SQUEEZE.format('text')} AS t FROM documents)",
    "dehyphenate_merge": rf"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id,
        regexp_replace(regexp_replace(text, '([A-Za-z])-\n{_S}*([A-Za-z])', '\1\2', 'g'), '([A-Za-z0-9])\n{_S}*([A-Za-z0-9])', '\1\2', 'g') AS t FROM documents)""",
    "acronym_expand": f"SELECT p_partkey, {_expanded('p_type', list(ACRONYMS))} AS in_order, {_expanded('p_type', sorted(ACRONYMS, key=len, reverse=True))} AS longest_first FROM part",
    "slugify": rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', '_', 'g'), '_') AS s FROM documents),
        h AS (SELECT doc_id, s, substring(s, 1, 80) AS h, strpos(reverse(substring(s, 1, 80)), '_') AS r FROM s)
        SELECT doc_id, CASE WHEN o = '' THEN 'unknown' ELSE o END AS slug FROM (SELECT doc_id,
          CASE WHEN length(s) <= 80 THEN s WHEN r > 0 AND 80 - r > 40 THEN trim(substring(h, 1, 80 - r), '_') ELSE trim(h, '_') END AS o FROM h)""",
    "norm_key": r"""SELECT c_custkey, trim(regexp_replace(lower(c_name || ' - ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS key,
        regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS letters FROM customer""",
    "edge_strip": f"SELECT doc_id, {_edges('t')} AS stripped FROM (SELECT doc_id, {_SQUEEZE.format('text')} AS t FROM documents)",
    "sentence_split_a": rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_SQUEEZE.format('text')}, '([.!?;]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
        SELECT doc_id, (i - 1)::BIGINT AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "sentence_split_b": rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_SQUEEZE.format('text')}, '([.!?]) +([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x) > 30) AS s FROM documents)
        SELECT doc_id, (i - 1)::BIGINT AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "sentence_split_c": rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])["'')\]}},]*\s+', '\1' || chr(1), 'g'), '"[\w -]{{1,30}}"\s*:|\\n|\n', chr(1), 'g') AS t FROM documents),
        s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS s FROM m)
        SELECT doc_id, (i - 1)::BIGINT AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "block_flags": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
        w AS (SELECT *, {_WORDS} AS n FROM l)
        SELECT doc_id, pos, regexp_matches(t, '(?i)https?://\S+|doi:\s*\S+|www\.\S+|downloaded from|accessed on|retrieved from') AS url,
          t <> '' AND length(t) <= 220 AND regexp_matches(t, '\b\d{{1,4}}\s*$') AND (regexp_matches(t, '\.{{3,}}') OR (regexp_matches(t, '^\d+(?:\.\d+)+') AND n <= 18)) AS contents,
          regexp_matches(t, '^\s*$') OR regexp_matches(t, '^\s*[IVX0-9\s.\-]+\s*$') OR (n <= 2 AND regexp_matches(t, '(?i)^[IVX]+[a-z]?\s+[A-C]?\s*$')) AS artifact,
          t <> '' AND length(t) <= 60 AND (regexp_matches(t, '^[A-Z0-9\s.,\-:;]{{1,60}}$') OR (length(t) <= 30 AND regexp_matches(t, '\d{{4}}\s*$'))) AS metadata,
          regexp_matches(trim(t), '^\d+\.\s+[A-Z][a-z]+\s+[A-Z]') OR regexp_matches(t, '(?i)\bet\s+al\.?\b') AS reference FROM w""",
    "caps_share": r"""SELECT doc_id, CASE WHEN n > 0 THEN round(u / n, 6) END AS share, pipes FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS u, length(text) - length(replace(text, '|', '')) AS pipes FROM documents)""",
    "page_drop_flags": r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{2,}') AS w, string_split(text, chr(10)) AS b,
          list_filter(list_transform(string_split(regexp_replace(text, '\.[ \t\n\v\f\r]+', '.' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
        c AS (SELECT *, len(list_filter(w, lambda x: upper(x) = x)) AS caps, len(list_filter(l, lambda x: regexp_matches(x, '^\d+\.\s+[A-Z][a-z]+\s+[A-Z]') OR regexp_matches(x, '(?i)\bet\s+al\.?\b'))) AS refs FROM w)
        SELECT doc_id, length(trim(text)) < 80 OR regexp_matches(substring(lower(text), 1, 250), '\blist of\s+(?:tables|figures|abbreviations)\b') OR (len(w) > 50 AND caps / len(w) > 0.35)
          OR (len(b) >= 5 AND len(l) >= 8 AND refs / len(l) >= 0.85) AS dropped FROM c""",
    "fact_gate": rf"""SELECT item_id, n >= 8 AND NOT regexp_matches(t || '; ', '(?:\b[A-Z0-9][\w\-–]{{0,12}}\s*[,=]\s*[a-zA-Z][^;]{{2,80}}; ){{2,}}')
          AND NOT regexp_matches(t, '(?i)\bet al\b|\b\d{{4}};\s*\d+|\bdoi\b|\bJ Am Coll\b|\bEur Heart J\b|\bJACC\b') AS fact, n::BIGINT AS n_words
        FROM (SELECT item_id, text AS t, {_WORDS} AS n FROM (SELECT item_id, text, text AS t FROM benchmark))""",
    "search_tokens": rf"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(translate(lower(regexp_replace(text, '\b([A-Z][A-Z0-9]+)s\b', '\1', 'g')), '-/', '  '), '[a-z0-9]+'),
        lambda x: NOT list_contains({_STOPS}, x)), lambda x: CASE WHEN length(x) > 4 AND x[-1] = 's' THEN x[:-2] ELSE x END), ' ') AS words FROM documents""",
}
