"""SQL over the same tables for the queries that SQL can express (DuckDB's dialect)."""

from __future__ import annotations

from corpusloom.llm import license_scan as scan
from corpusloom.llm import quality_rules as rules

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS spot
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM r),
f AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0)::BIGINT AS filled, coalesce(sum(w) OVER before, 0)::BIGINT AS gone,
         (sum(source_size) OVER ())::BIGINT AS words, (sum(w) OVER ())::BIGINT AS all_w
  FROM w WINDOW before AS (ORDER BY source_size::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (words * 1.5::DOUBLE - filled * 2) / (all_w - gone) AS level FROM f),
b AS (SELECT arg_min(level, gone) AS level FROM l WHERE level * w <= source_size * 2),
t AS (SELECT source, source_size, least((SELECT level FROM b) * w, source_size * 2::DOUBLE) AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM p),
o AS (SELECT source, spot, sum(size) OVER (PARTITION BY source ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * q.whole + greatest(0, least(d.size, q.rest - (o.upto - d.size))))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.spot = o.spot
"""

OP9 = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS item_row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark),
sized AS (SELECT *, least(5, len(w)) AS k FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_row, item_id, k, array_to_string(w[i : i + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
n AS (SELECT item_row, count(*)::BIGINT AS n_shingles FROM wanted GROUP BY item_row),
widths AS (SELECT DISTINCT k FROM sized),
own AS (
  SELECT DISTINCT row_id, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS sh
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM words, widths WHERE len(w) >= k)),
hits AS (SELECT row_id, doc_id, item_row, item_id, count(*)::BIGINT AS n_shared FROM own JOIN wanted USING (k, sh) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles FROM hits JOIN n USING (item_row) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""

#: Every shortest window of 50 words by its own text.
OP10 = r"""
WITH lines AS (
  SELECT doc_id, text, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM lines),
ahead AS (SELECT a.doc_id, a.pos AS i, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.w >= a.w - a.words + 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.pos) AS i, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.w >= a.w - a.words + 50 GROUP BY b.doc_id, b.pos),
spans AS (SELECT doc_id, i, e FROM ahead UNION SELECT doc_id, i, e FROM back),
keyed AS (SELECT s.doc_id, i, e, array_to_string(string_split(d.text, chr(10))[i + 1 : e + 1], chr(10)) AS body FROM spans s JOIN documents d USING (doc_id)),
again AS (SELECT doc_id, i, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM keyed) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS pos FROM again),
isles AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM gone),
runs AS (SELECT doc_id, string_agg(run, ',' ORDER BY i) AS runs FROM (SELECT doc_id, min(pos) AS i, min(pos)::VARCHAR || '-' || max(pos)::VARCHAR AS run FROM isles GROUP BY doc_id, isle) GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS body
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(runs, '') AS runs,
       CASE WHEN d.text IS NOT NULL THEN sha256(body) END AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

def _quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def rules_sql() -> str:
    """Counts, histograms in long form, references and distances, from the operator's parameters."""
    common = ", ".join(f"('{lang}', {_quoted(dict.fromkeys(words))})" for lang, words in rules.COMMON.items())
    cells = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[ \t\v\f\r]", "newline": r"\n", "stop": r"[.,;:!?''\"()\-]"}
    counted = "".join(f"UNION ALL SELECT rid, lang, 'c', '{k}', length(t) - length(regexp_replace(t, '{v}', '', 'g')) FROM d " for k, v in cells.items())[10:]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1), range(3) r(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT w.rid, w.doc_id, w.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
lists(lang, words) AS (VALUES {common}),
ascii AS ({counted}),
chars AS (SELECT * FROM ascii UNION ALL SELECT rid, lang, 'c', 'beyond', strlen(t) - strlen(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) FROM d
  UNION ALL SELECT rid, lang, 'c', 'other', length(regexp_replace(t, '[^\x00-\x7F]|[a-zA-Z0-9 \t\v\f\r\n.,;:!?''"()\-]', '', 'g')) FROM d) ,
tok AS (SELECT rid, w.lang, regexp_replace(translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') AS x FROM w),
said AS (SELECT rid, lang, 'w', CASE WHEN list_contains(words, x) THEN x ELSE '' END, count(*) FROM tok JOIN lists USING (lang) GROUP BY ALL),
hist(rid, lang, kind, cell, n) AS (SELECT * FROM chars UNION ALL SELECT * FROM said),
passed AS (SELECT lang, count(*) AS docs FROM f WHERE NOT base_failed GROUP BY lang),
sums AS (SELECT h.lang, kind, cell, sum(n) AS n FROM hist h JOIN f USING (rid) WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT rid, lang, kind, cell, n / nullif(sum(n) OVER (PARTITION BY rid, kind), 0) AS p, sum(n) OVER (PARTITION BY rid, kind) AS total FROM hist),
q AS (SELECT lang, kind, cell, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM sums),
every AS (SELECT DISTINCT p.rid, p.lang, p.kind, q.cell, p.total FROM p JOIN q USING (lang, kind) UNION SELECT rid, lang, kind, cell, total FROM p),
m AS (SELECT e.rid, e.lang, e.kind, e.total, coalesce(p.p, 0) AS p, coalesce(q.q, 0) AS q FROM every e LEFT JOIN p USING (rid, kind, cell) LEFT JOIN q ON q.lang = e.lang AND q.kind = e.kind AND q.cell = e.cell),
js AS (SELECT rid, lang, kind, any_value(total) AS total, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist FROM m GROUP BY rid, lang, kind),
far AS (SELECT rid, bool_or((kind = 'c' AND total >= {rules.MIN_CHARS} AND dist > {rules.MAX_CHAR_DISTANCE}) OR (kind = 'w' AND total >= {rules.MIN_WORDS} AND dist > {rules.MAX_WORD_DISTANCE})) AS far
  FROM js JOIN passed USING (lang) WHERE docs >= {rules.MIN_REFERENCE} GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept FROM f LEFT JOIN far USING (rid)
"""


def license_sql() -> str:
    """Every phrase at every word, every block against every template."""
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{label}', {_quoted(p.split())})" for p, label in scan.PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', {_quoted(scan._words(text))}, {scan.block_length(text)})" for i, (label, text) in enumerate(scan.TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{token}') AS w FROM d),
phrases(label, words) AS (VALUES {phrases}),
templates(tid, label, words, length) AS (VALUES {templates}),
places AS (SELECT rid, label, i FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM w) x, phrases p WHERE x.w[i + 1 : i + len(words)] = words),
near AS (SELECT rid, w, tid, label, words, length FROM w, templates WHERE len(list_intersect(w, words)) >= ceil({scan.THRESHOLD} * len(words) - 1e-9)),
begins AS (SELECT *, unnest(range(0, len(w))) AS i FROM near),
runs AS (SELECT rid, label, words, list_distinct(w[i + 1 : i + length]) AS held FROM begins WHERE list_contains(words, w[i + 1])),
hits AS (SELECT rid, label, len(list_intersect(held, words)) / len(words) AS c FROM runs WHERE len(list_intersect(held, words)) >= ceil({scan.THRESHOLD} * len(words) - 1e-9)),
base AS (SELECT rid, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION SELECT rid, label FROM hits) GROUP BY rid),
best AS (SELECT rid, max(c) AS c FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)
"""


ORACLES = {"op2_rules": rules_sql(), "op8_license": license_sql(), "op4_mixing": OP4, "op9_decontamination": OP9, "op10_line_dedup": OP10}
