"""Queries over tables: their roles, and their rows as entity rows.

The tables of the normalisers are made of all parts, one table for each brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import roles
from corpusloom.operators import layout, mentions, normalise
from corpusloom.plans._tables import read
from corpusloom.sources import sinks

#: (caption, headers, first row, role): two tables or more for each role, and some of none.
ROLE_TABLES = (
    ("", ["Recommendations for the management of patients", "Note"], [], "recommendation"), ("", ["COR", "LOE", "Text"], [], "recommendation"), ("", ["Class", "Level", "Text"], [], "recommendation"),
    ("Recommendations and their class", ["x"], [], "recommendation"), ("", ["In patients with a long first header it is useful", "II", "B"], [], "recommendation"), ("", ["In patients with a long first header it is useful", "IIa", "B"], [], None),
    ("", ["Agent", "Daily amount"], [], "drug_dosing"), ("", ["Starting", "Target", "Dose"], [], "drug_dosing"), ("Commonly used medications", ["x"], [], "drug_dosing"), ("", ["Medication", "Infusion"], [], "drug_dosing"),
    ("", ["Drug", "Magnitude"], [], "harmful_drug"), ("Agents that may cause trouble", ["x"], [], "harmful_drug"), ("", ["Therapeutic class", "Side effects"], [], "harmful_drug"),
    ("Inotropic support", ["x"], [], "inotropic_agent"), ("", ["Infusion", "Dosing"], [], "inotropic_agent"),
    ("", ["Stage", "Definition"], [], "stage"), ("Stages and their criteria", ["x"], [], "stage"),
    ("SCAI profiles", ["Profile", "x"], [], "staging_classification"), ("INTERMACS", ["Hemodynamics"], [], "staging_classification"), ("no letters", ["Features"], [], None),
    ("", ["Phenotype"], [], "phenotype"), ("Classification by LVEF", ["x"], [], "phenotype"), ("", ["x"], ["Type of trouble"], "phenotype"), ("", ["Type of trouble"], [], "phenotype"),
    ("", ["Etiology"], [], "cause"), ("Causes of it", ["x"], [], "cause"), ("Natriuretic peptide causes", ["Cause"], [], "natriuretic_cause"),
    ("Comorbidities", ["x"], [], "comorbidity"), ("Chronic conditions", ["Condition"], [], "comorbidity"), ("Risk scores", ["x"], [], "risk_score"), ("", ["Risk score", "Year"], [], "risk_score"), ("Risk that predicts", ["x"], [], "risk_score"),
    ("", ["Barrier", "Screening"], [], "self_care_barrier"), ("Self-care", ["x"], [], "self_care_barrier"), ("Vulnerable groups", ["x"], [], "vulnerable_population"), ("Disparities", ["x"], [], "vulnerable_population"),
    ("", ["NNT"], [], "therapy_benefit"), ("Benefit and evidence", ["x"], [], "therapy_benefit"), ("Cardiotoxicity", ["x"], [], "cardiotoxic_agent"), ("Cancer treatment", ["Monitoring"], [], "cardiotoxic_agent"),
    ("", ["Preconception"], [], "pregnancy_management"), ("Pregnancy", ["x"], [], "pregnancy_management"), ("", ["Phenotypic category"], [], "genetic_factor"), ("Genetic cardiomyopathy", ["x"], [], "genetic_factor"),
    ("Precipitating factors", ["x"], [], "precipitating_factor"), ("Precipitating", ["x"], [], None), ("Elevated natriuretic levels", ["x"], [], "natriuretic_cause"),
    ("", ["Title", "Publication year"], [], "associated_guideline"), ("Associated guidelines", ["x"], [], "associated_guideline"), ("", ["Measure no."], [], "performance_measure"), ("Quality", ["x"], [], "performance_measure"),
    ("Palliative", ["x"], [], "palliative_care"), ("Supportive care", ["x"], [], "palliative_care"), ("Advanced disease: criteria", ["x"], [], "advanced_hf_def"), ("Clinical indicators", ["x"], [], "clinical_indicator"),
    ("", ["SBP"], [], "shock_criteria"), ("Shock: hemodynamic picture", ["x"], [], "shock_criteria"), ("Transitional visits", ["x"], [], "transitional_care"), ("A care plan", ["x"], [], "transitional_care"),
    ("Durable support: contraindications", ["x"], [], "mcs_indication"), ("LVAD indications", ["x"], [], "mcs_indication"), ("Evidence gaps", ["x"], [], "evidence_gap"), ("Future research", ["x"], [], "evidence_gap"),
    ("Appendix: causes", ["Cause"], [], None), ("", ["Reviewer", "Cause"], [], None), ("", ["x"], [], None), (None, ["COR", "LOE"], [], "recommendation"))
ROLES_OF_BRANDS = ("recommendation", "drug_dosing", "therapy_benefit", "harmful_drug", "stage", "phenotype", "cause", "comorbidity")


def table_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, caption, headers, first) for i, (caption, headers, first, _) in enumerate(ROLE_TABLES)]
    t = spark.createDataFrame(rows, "id long, caption string, headers array<string>, first array<string>")
    role = roles.classify(F.col("headers"), F.col("caption"), F.col("first"))
    return t.select("id", role.alias("role"), F.coalesce(role.isin(*roles.SPECIFIC), F.lit(False)).alias("specific"))


def _headers(role: str) -> list[str]:
    return {
        "recommendation": ["COR", "LOE", "Recommendations"], "drug_dosing": ["Drug class", "Drug", "Initial daily dose", "Maximum dose", "Duration"], "therapy_benefit": ["Evidence-based therapy", "NNT"],
        "harmful_drug": ["Drug", "Mechanism"], "stage": ["Stage", "Definition"], "phenotype": ["Type", "Criteria"], "cause": ["Cause", "Note"], "comorbidity": ["Condition", "", "Prevalence"]}[role]


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(tables, cells): each brand is a table, its parts are the rows; brands have one of eight roles."""
    p = read(spark, d, "part").withColumn("no", F.regexp_extract("p_brand", r"\d+", 0).cast("int"))
    at = (F.col("no") % 8 + 1).cast("int")
    role = F.element_at(F.array(*map(F.lit, ROLES_OF_BRANDS)), at)
    heads = F.element_at(F.array(*(F.array(*map(F.lit, _headers(r))) for r in ROLES_OF_BRANDS)), at)
    tables = p.select(F.concat(F.lit("t"), "no").alias("table_id"), F.lit(1).alias("page"), F.concat(F.lit("Table "), F.col("no"), F.lit(": the NYHA"), F.when(F.col("no") % 2 == 0, " class and Starting").otherwise("")).alias("caption"), heads.alias("headers"), role.alias("role")).distinct()
    name, size, price = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("int").cast("string")
    long = F.concat(F.lit("It is useful to have a "), name, F.lit(" of size "), size)
    cells = {
        "recommendation": F.array(F.lit("I"), F.lit("B"), F.when(F.col("p_size") % 3 == 0, name).otherwise(long)),
        "drug_dosing": F.array(F.lit("x"), F.when(F.col("p_size") % 7 == 0, "NR").otherwise(name), price, size, F.lit(None).cast("string")),
        "therapy_benefit": F.array(F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit(" ablation"))).when(F.col("p_size") % 4 == 1, F.concat(name, F.lit(" training"))).otherwise(name), size),
        "harmful_drug": F.array(F.concat(F.lit(" "), name), size), "stage": F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Stage "), (F.col("p_size") % 6).cast("string"))).otherwise(name), long),
        "phenotype": F.array(F.when(F.col("p_size") % 3 == 0, "HFrEF of old").when(F.col("p_size") % 3 == 1, "Annual visits").otherwise(name), long),
        "cause": F.array(F.when(F.col("p_size") % 3 == 0, "Randomized bolts").when(F.col("p_size") % 5 == 0, size).otherwise(name), size), "comorbidity": F.array(name, size)}
    cell = F.element_at(F.array(*(F.transform(cells[r], lambda c: c) for r in ROLES_OF_BRANDS)), at)
    sub = F.array(*([F.concat(F.lit("Group "), F.col("p_size").cast("string"))] * 5))
    cell = F.when((role == "drug_dosing") & (F.col("p_size") % 10 == 3), sub).otherwise(cell)
    return tables, p.select(F.concat(F.lit("t"), "no").alias("table_id"), F.col("p_partkey").cast("int").alias("row_no"), cell.alias("cells"))


def table_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return normalise.recommendations(*_tables(spark, d))


def table_drugs(spark: SparkSession, d: str) -> DataFrame:
    return normalise.drugs(*_tables(spark, d))[0]


def table_drug_groups(spark: SparkSession, d: str) -> DataFrame:
    return normalise.drugs(*_tables(spark, d))[1]


def table_therapies(spark: SparkSession, d: str) -> DataFrame:
    return normalise.therapies(*_tables(spark, d))


def table_harmful(spark: SparkSession, d: str) -> DataFrame:
    return normalise.harmful(*_tables(spark, d))


def table_stages(spark: SparkSession, d: str) -> DataFrame:
    return normalise.stages(*_tables(spark, d))


def table_phenotypes(spark: SparkSession, d: str) -> DataFrame:
    return normalise.phenotypes(*_tables(spark, d))


def table_causes(spark: SparkSession, d: str) -> DataFrame:
    return normalise.causes(*_tables(spark, d))


def table_references(spark: SparkSession, d: str) -> DataFrame:
    found = normalise.references(*_tables(spark, d), ("comorbidity",))
    return found.select("role", "table_id", F.col("row_no").cast("long").alias("row_no"), F.col("payload")["Condition"].alias("condition"), F.col("payload")["column_1"].alias("second"), F.map_contains_key("payload", F.lit("Prevalence")).alias("third"))


def table_quarantine(spark: SparkSession, d: str) -> DataFrame:
    t, _ = _tables(spark, d)
    return sinks.quarantine(t, t.where(F.col("role").isin(*roles.SPECIFIC))).select("table_id", "role")


def entity_table_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Two contributions to one entity table: columns filled, rows stamped with the document where they have none."""
    causes = normalise.causes(*_tables(spark, d))
    more = read(spark, d, "region").select(F.concat(F.lit("cause_"), "r_name").alias("cause_id"), F.lit("own").alias("guideline_id"))
    return sinks.entity_table(spark, "S_cause", causes, more, document="doc")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Ten blocks and more of each conversation: its turns, with titles among them."""
    c = read(spark, d, "conversations")
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("2024 Guideline for the management of heart "), F.col("conv_id").cast("string"), F.lit(" disease (draft), 12"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Society "), F.col("role"), F.lit(" of 2019"))).otherwise("plain text")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("block_no"), text.alias("text"))


_TITLE = (r"Guideline for the management of (.*)",)


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    return normalise.metadata(_blocks(spark, d), (r"(Guideline for [a-z ]+\d+)",), r"Society \w+")


def document_condition(spark: SparkSession, d: str) -> DataFrame:
    return mentions.condition(_blocks(spark, d), _TITLE, r"\b(plain text)\b")


def contains_rows(spark: SparkSession, d: str) -> DataFrame:
    recs = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("guideline_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("rec_"), F.col("o_orderkey").cast("string"))).alias("rec_id"))
    return mentions.contains(recs, "cond")


def condition_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "part").select(F.col("p_brand").alias("guideline_id"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("stage_"), F.col("p_size").cast("string"))).alias("stage_id"))
    return mentions.pairs(e, "stage_id", "cond")


def _page_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as blocks of a page: place by part and supplier, size by quantity."""
    l = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("no")).agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"), F.min("l_quantity").alias("q"))  # noqa: E741
    kind = F.col("x") % 6
    text = F.when(kind == 0, "PAGE TITLE").when(kind == 1, F.concat(F.lit("Table "), F.col("no").cast("string"), F.lit(" of it"))).when(kind == 2, "12").when(kind == 3, F.lit("VERTICAL MARK")).otherwise("Some words of running text, long enough to be kept by all tests of the page")
    b = l.select("doc", F.when(F.col("doc") % 2 == 0, 1).otherwise(9).alias("page"), F.col("no").cast("int").alias("block_no"), (F.col("x") % 600).cast("double").alias("x0"), (F.col("y") % 700).cast("double").alias("y0"), (F.col("x") % 600 + 60).cast("double").alias("x1"), (F.col("y") % 700 + F.col("q") * 4).cast("double").alias("y1"), text.alias("text"))
    return b, b.select("doc", "page").distinct().select("doc", "page", F.lit(600.0).alias("width"), F.lit(100.0).alias("height"))


def page_kept_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.kept_blocks(*_page_blocks(spark, d)).select("doc", F.col("block_no").cast("long").alias("block_no"))


def page_reading_order(spark: SparkSession, d: str) -> DataFrame:
    found = layout.reading_order(*_page_blocks(spark, d), least=4, share=0.1, side=2)
    return found.select("doc", F.col("block_no").cast("long").alias("block_no"), F.col("column").cast("long").alias("col"), F.col("place").cast("long").alias("place"))


def table_captions(spark: SparkSession, d: str) -> DataFrame:
    b, _ = _page_blocks(spark, d)
    t = b.where("block_no = 2").select("doc", "page", F.col("doc").alias("table_id"), "y0", "y1")
    return layout.captions(t, b, above=30, below=10, slack=5).where("caption is not null").select("doc", "caption")


def page_references_cut(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 100).cast("int").alias("page"), (F.col("value") / 100).alias("v"), (F.col("event_type") == "error").alias("h"))
    pages = e.groupBy("doc", "page").agg(F.max("h").alias("heading"), F.round(F.max("v"), 3).alias("density"))
    return layout.references_cut(pages, 2, 0.2).select("doc", F.col("cut_page").cast("long").alias("cut_page"))


QUERIES = {f.__name__: f for f in (
    table_roles, table_recommendations, table_drugs, table_drug_groups, table_therapies, table_harmful, table_stages, table_phenotypes, table_causes, table_references, table_quarantine,
    entity_table_stamped, document_metadata, document_condition, contains_rows, condition_pairs, page_kept_blocks, page_reading_order, table_captions, page_references_cut)}


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_P = r"p AS (SELECT *, regexp_extract(p_brand, '\d+')::INT AS no, regexp_extract(p_brand, '\d+')::INT % 8 AS k, p_retailprice::DECIMAL(18, 4) AS price FROM part)"
_SLUG = "trim(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '_')"
_LONG = "'It is useful to have a ' || p_name || ' of size ' || p_size"
_KIND = "CASE WHEN contains({0}, 'ablation') THEN 'device/procedure' WHEN contains({0}, 'training') THEN 'non-pharmacological' ELSE 'pharmacological' END"
_B = """l AS (SELECT l_orderkey AS doc, l_linenumber AS no, min(l_partkey) AS x, min(l_suppkey) AS y, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
  b AS (SELECT doc, no, x % 6 AS k, (x % 600)::DOUBLE AS x0, (y % 700)::DOUBLE AS y0, (y % 700 + q * 4)::DOUBLE AS y1, CASE x % 6 WHEN 1 THEN 'Table ' || no || ' of it' END AS cap FROM l)"""
_DRUGS = rf"""{_P}, r AS (SELECT *, CASE WHEN p_size % 10 = 3 THEN 'Group ' || p_size WHEN p_size % 7 = 0 THEN 'NR' ELSE p_name END AS name, p_size % 10 = 3 AS sub FROM p WHERE k = 1),
  c AS (SELECT *, coalesce(last_value(CASE WHEN sub THEN name END IGNORE NULLS) OVER (PARTITION BY no ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CASE WHEN no % 2 = 0 THEN 'nyha' ELSE 'nyha' END) AS category FROM r)"""

ORACLES = {
    "table_roles": "SELECT id::BIGINT AS id, role, specific FROM (VALUES " + ", ".join(f"({i}, {_text(role)}, {str(role in roles.SPECIFIC).lower()})" for i, (*_, role) in enumerate(ROLE_TABLES)) + ") t(id, role, specific)",
    "table_recommendations": rf"WITH {_P} SELECT 'rec_t' || no || '_' || p_partkey AS rec_id, {_LONG} AS \"recommendationText\" FROM p WHERE k = 0 AND p_size % 3 <> 0".replace('\\"', '"'),
    "table_drugs": f"""WITH {_DRUGS} SELECT 'drug_' || {_SLUG.format('name')} AS drug_id, name AS "agentName", p_retailprice::INT::VARCHAR AS "minDose", p_size::VARCHAR AS "maxDose", '' AS duration, category AS "drugCategory" FROM c WHERE NOT sub AND name <> 'NR'""".replace("p_retailprice::INT", "floor(p_retailprice)::INT"),
    "table_drug_groups": f"""WITH {_DRUGS} SELECT 'therapy_' || {_SLUG.format('name')} AS therapy_id, 'pharmacological' AS "therapyType", name AS therapy_name FROM c WHERE sub""",
    "table_therapies": f"""WITH {_P}, r AS (SELECT p_name || CASE p_size % 4 WHEN 0 THEN ' ablation' WHEN 1 THEN ' training' ELSE '' END AS name FROM p WHERE k = 2)
        SELECT 'therapy_' || {_SLUG.format('name')} AS therapy_id, {_KIND.format('name')} AS "therapyType", name AS therapy_name FROM r""",
    "table_harmful": f"""WITH {_P} SELECT 'ae_' || {_SLUG.format('p_name')} AS ae_id, p_name AS "adverseEventName", 'harmful' AS "adverseEventSeverity" FROM p WHERE k = 3""",
    "table_stages": f"""WITH {_P}, r AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'Stage ' || p_size % 6 ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN (p_size % 6)::VARCHAR ELSE {_SLUG.format('p_name')}[:20] END AS lvl FROM p WHERE k = 4)
        SELECT 'stage_' || {_SLUG.format('lvl')} AS stage_id, 'NYHA' AS "stageScheme", lvl AS "stageLevel", name AS "stageName", {_LONG} AS "StageCriteriaText" FROM r""",
    "table_phenotypes": f"""WITH {_P}, r AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'HFrEF' ELSE {_SLUG.format('p_name')}[:20] END AS code FROM p WHERE k = 5 AND p_size % 3 <> 1)
        SELECT 'phenotype_' || {_SLUG.format('code')} AS phenotype_id, code AS "phenotypeCode", {_LONG} AS "phenotypeCriteria" FROM r""",
    "table_causes": f"""WITH {_P} SELECT 'cause_' || {_SLUG.format('p_name')} AS cause_id, p_name AS "causeName" FROM p WHERE k = 6 AND p_size % 3 <> 0 AND p_size % 5 <> 0""",
    "table_references": f"WITH {_P} SELECT 'comorbidity' AS role, 't' || no AS table_id, p_partkey AS row_no, p_name AS condition, p_size::VARCHAR AS second, false AS third FROM p WHERE k = 7",
    "table_quarantine": f"WITH {_P} SELECT DISTINCT 't' || no AS table_id, 'comorbidity' AS role FROM p WHERE k = 7",
    "entity_table_stamped": f"""WITH {_P} SELECT 'doc' AS guideline_id, 'cause_' || {_SLUG.format('p_name')} AS cause_id, p_name AS "causeName" FROM p WHERE k = 6 AND p_size % 3 <> 0 AND p_size % 5 <> 0
        UNION ALL SELECT 'own', 'cause_' || r_name, '' FROM region""",
    "document_metadata": """WITH t AS (SELECT conv_id, min(turn) FILTER (turn % 4 = 1 AND turn < 10) AS one, min(turn) FILTER (turn % 4 = 2 AND turn < 10) AS two FROM conversations WHERE turn < 10 GROUP BY conv_id)
        SELECT t.conv_id AS doc, CASE WHEN one IS NULL THEN 'Unknown Guideline' ELSE 'Guideline for the management of heart ' || t.conv_id END AS title,
          coalesce((SELECT min('Society ' || role) FROM conversations c WHERE c.conv_id = t.conv_id AND c.turn = two), '') AS source, CASE WHEN one IS NOT NULL THEN '2024' WHEN two IS NOT NULL THEN '2019' ELSE '' END AS year FROM t""",
    "document_condition": """WITH t AS (SELECT conv_id, count(*) FILTER (turn % 4 = 1 AND turn < 10) > 0 AS one, count(*) FILTER (turn % 4 IN (0, 3) AND turn < 15) > 0 AS two FROM conversations GROUP BY conv_id)
        SELECT conv_id AS doc, CASE WHEN one THEN 'heart_' || conv_id || '_disease' WHEN two THEN 'plain_text' ELSE 'Unknown' END AS condition_id,
          CASE WHEN one THEN 'heart ' || conv_id || ' disease' WHEN two THEN 'plain text' ELSE 'Unknown Condition' END AS "conditionName" FROM t""",
    "contains_rows": """WITH r AS (SELECT DISTINCT o_custkey::VARCHAR AS guideline_id, CASE WHEN o_orderkey % 3 > 0 THEN 'rec_' || o_orderkey END AS rec_id FROM orders),
        x AS (SELECT guideline_id, rec_id FROM r WHERE rec_id IS NOT NULL UNION ALL SELECT guideline_id, '' FROM r GROUP BY guideline_id HAVING count(rec_id) = 0)
        SELECT guideline_id, 'cond' AS condition_id, rec_id, 'contains_' || CASE WHEN rec_id = '' THEN guideline_id ELSE rec_id END AS contains_id FROM x""",
    "condition_pairs": "SELECT DISTINCT p_brand AS guideline_id, 'cond' AS condition_id, 'stage_' || p_size AS stage_id FROM part WHERE p_size % 3 > 0",
    "page_kept_blocks": f"""WITH {_B} SELECT doc, no::BIGINT AS block_no FROM b WHERE k > 3 OR (doc % 2 = 1 AND k IN (0, 3) AND NOT (y0 <= 12 OR y1 >= 90) AND NOT (y1 - y0 >= 18 AND (x0 <= 48 OR x0 + 60 >= 552)))""",
    "page_reading_order": f"""WITH {_B}, g AS (SELECT doc, x0, lead(x0) OVER (PARTITION BY doc ORDER BY x0) - x0 AS gap, count(*) OVER (PARTITION BY doc) AS n FROM b),
        w AS (SELECT doc, n, arg_min(x0 + gap / 2, (-gap, x0)) AS cut, max(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY doc, n),
        c AS (SELECT b.*, CASE WHEN n >= 4 AND gap >= 60 AND x0 >= cut THEN 1 ELSE 0 END AS side FROM b LEFT JOIN w USING (doc)),
        e AS (SELECT *, CASE WHEN sum(side) OVER (PARTITION BY doc) >= 2 AND sum(1 - side) OVER (PARTITION BY doc) >= 2 THEN side ELSE 0 END AS col FROM c)
        SELECT doc, no::BIGINT AS block_no, col::BIGINT AS col, row_number() OVER (PARTITION BY doc ORDER BY col, y0, x0, no) AS place FROM e""",
    "table_captions": f"""WITH {_B}, t AS (SELECT doc, y0 AS ty0, y1 AS ty1 FROM b WHERE no = 2),
        c AS (SELECT t.doc, cap, no FROM t JOIN b ON t.doc = b.doc WHERE cap IS NOT NULL AND ((y1 <= ty0 + 5 AND ty0 - y1 <= 30) OR (y0 >= ty1 - 5 AND y0 - ty1 <= 10)))
        SELECT doc, arg_min(cap, no) AS caption FROM c GROUP BY doc""",
    "page_references_cut": """WITH p AS (SELECT user_id AS doc, event_id // 100 AS page, bool_or(event_type = 'error') AS h, round(max(value / 100), 3) AS v FROM events GROUP BY ALL),
        one AS (SELECT doc, min(page) AS c FROM p WHERE h AND v >= 0.25 GROUP BY doc),
        i AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS isle FROM p WHERE v >= 0.2),
        two AS (SELECT doc, max(s) AS c FROM (SELECT doc, min(page) AS s FROM i GROUP BY doc, isle HAVING count(*) >= 2) GROUP BY doc)
        SELECT doc, coalesce(one.c, two.c) AS cut_page FROM one FULL JOIN two USING (doc)""",
}
