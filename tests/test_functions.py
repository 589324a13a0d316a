"""Text functions, roles, scores, normalisers, extractors, layout, graph and models on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import roles
from corpusloom.functions import text as T
from corpusloom.operators import extract, graph, layout, linking, merge, models, normalise, order, relations, scoring
from corpusloom.sources import blocks, readers, sinks


@pytest.fixture(scope="module")
def one(spark):
    def apply(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    return apply


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.squeeze, " a \n\t b ", "a b"), (T.dehyphenate, "treat-\n  ment", "treatment"), (T.join_lines, "a\nb\nc", "ab\nc"), (T.without_control, "a\x07b\n", "ab\n"),
    (T.strip_edges, "and the drug of the", "drug"), (T.strip_edges, " (heart failure). ", "heart failure"), (T.slug, "  ", "unknown"), (T.slug, None, "unknown"), (T.slug, "A b-C", "A_b_C"),
    (T.slug, "a" * 90, "a" * 80), (T.slug, "a" * 50 + " " + "b" * 50, "a" * 50), (T.slug, "a" * 30 + " " + "b" * 80, "a" * 30 + "_" + "b" * 49), (T.norm_key, " ACE-I (x) ", "ace_i_x"), (T.letters_key, "Beta-blocker 2", "betablocker2"),
    (T.search_words, "MRAs and the drugs/pills of class-ii", ["mra", "drug", "pill", "clas", "ii"]), (T.sentences, "One. Two; three! ", ["One.", "Two;", "three!"]),
    (T.is_contents, "1.2 Scope of work 12", True), (T.is_contents, "Intro ..... 7", True), (T.is_contents, "Intro 7", False), (T.is_artifact, " IV. 2 ", True), (T.is_artifact, "text", False),
    (T.is_caption, "Table 3 Causes", True), (T.is_caption, "a | b c | d", True), (T.is_caption, "see the text", False), (T.is_reference_line, "12. Smith J", True), (T.is_noisy, "a|b|c|d|e", True),
    (T.is_noisy, "HEART FAILURE CARE", True), (T.is_fragment, "of the heart", True), (T.is_fragment, "heart rate", False), (T.caps_share, "Ab", 0.5), (T.caps_share, "12", None), (T.n_words, " a  b ", 2), (T.n_words, None, 0),
    (T.is_fact, "This is a sentence of more than eight words", True), (T.is_fact, "Too short", False), (T.is_fact, "ACE, angiotensin enzyme; ARB, angiotensin blocker; MRA, a mineral thing; and more words here", False),
    (lambda c: T.merged_paragraphs(c), "treated with\n\ndrugs that should be\n\ngiven\n\nlater", "treated with drugs that should be given\n\nlater"),
    (lambda c: T.expand(c, {"HF": "heart failure", "HFx": "y"}), "HF HFx (HF)", "heart failure y (heart failure)"),
    (lambda c: T.abbreviation(c, {"icd": "implantable device"}, {"_ef": "_ejection_fraction"}), "i_c_d", "implantable_device"), (lambda c: T.abbreviation(c, {}, {"_ef": "_ejection_fraction"}), "low_ef", "low_ejection_fraction"),
    (scoring.normalized, "40% of three-fold 10g", "40 percent of 3 fold 10 g"), (scoring.says_nothing, "I can't help with this request", True), (scoring.says_nothing, "ok", True), (scoring.says_nothing, "Take a walk each day", False),
    (normalise.scheme, "Table: NYHA Stage of disease", "NYHA"), (normalise.scheme, "levels (ABC/DE)", "ABC/DE"), (normalise.scheme, "none", "unknown"), (normalise.therapy_type, "ICD implantation", "device/procedure"),
    (normalise.therapy_type, "exercise training", "non-pharmacological"), (normalise.therapy_type, "statin", "pharmacological"), (extract.assessment_key, "Echo-cardio graphic", "echocardiograph"), (extract.looks_truncated, "physical examina", True),
])
def test_columns(one, f, text, want):
    assert one(text, f) == want


def test_quantities(one):
    got = one("Take 10–20 mg for three days, one of them twice at 5", lambda c: F.transform(scoring.quantities(c), lambda q: F.concat_ws(" ", q["value"], q["unit"])))
    assert sorted(got) == ["10.0 mg", "20.0 mg", "3.0 day", "5.0"]


@pytest.mark.parametrize(("headers", "caption", "want"), [
    (["COR", "LOE", "x"], "", "recommendation"), (["Drug", "Dose"], "", "drug_dosing"), (["Drug", "Mechanism"], "", "harmful_drug"), (["Stage", "Definition"], "", "stage"), (["x"], "Causes", "cause"),
    (["x"], "Causes of raised natriuretic peptide", "natriuretic_cause"), (["x"], "Author Relationships", None), (["Reviewer"], "Causes", None), (["Profile"], "The SCAI shock", "staging_classification"), (["x"], "", None), (["x"], None, None),
    (["Type of HF"], "", "phenotype"), (["x"], "Contraindications of support", "mcs_indication"), (["x"], "Future research", "evidence_gap"), (["measure title"], "", "performance_measure"), ([], "Palliative", "palliative_care")])
def test_roles(spark, headers, caption, want):
    df = spark.createDataFrame([(headers, caption)], "h array<string>, c string")
    assert df.select(roles.classify(F.col("h"), F.col("c"))).first()[0] == want


def test_role_rescue_by_first_row(spark):
    df = spark.createDataFrame([(["0", "1"], ["Type of HF", "LVEF"])], "h array<string>, f array<string>")
    assert df.select(roles.generic_headers(F.col("h")), roles.classify(F.col("h"), F.lit(""), F.col("f"))).first() == (True, "phenotype")


def test_normalisers(spark):
    tables = spark.createDataFrame([
        ("d", "drug_dosing", "Commonly used oral diuretics", ["Drug class", "Drug", "Initial dose", "Target dose", "Duration"]), ("r", "recommendation", "", ["COR", "LOE", "Recommendations"]), ("s", "stage", "ACC/AHA stage", ["Stage", "Definition"]),
        ("p", "phenotype", "", ["Type", "LVEF"]), ("c", "cause", "", ["No", "Cause"]), ("h", "harmful_drug", "", ["Drug", "Effect"]), ("t", "therapy_benefit", "", ["Therapy", "NNT"]), ("q", "risk_score", "", ["Score", "", "Score"])],
        "table_id string, role string, caption string, headers array<string>")
    long = "In patients with heart failure and reduced ejection fraction a drug is recommended"
    cells = spark.createDataFrame([
        ("d", 0, ["x", "Furosemide", "20 mg", "40 mg", "6 h"]), ("d", 1, ["Thiazides"] * 5), ("d", 2, ["x", "Metolazone", "2 mg", "5 mg", ""]), ("d", 3, ["x", "NA", "", "", ""]), ("d", 4, ["x", "", "1", "", ""]),
        ("r", 0, ["1", "A", long]), ("r", 1, ["1", "A", "Table 3 of recommended things that are here for all"]), ("r", 2, ["1", "B", "short"]), ("s", 0, ["Stage C", "structural"]), ("p", 0, ["HFrEF", "<=40%"]), ("p", 1, ["Diuretics", ""]),
        ("c", 0, ["1", "Ischemic heart disease"]), ("c", 1, ["2", "12"]), ("h", 0, ["NSAIDs", "fluid"]), ("t", 0, ["ICD", "14"]), ("q", 0, ["a", "b", " c "])], "table_id string, row_no int, cells array<string>")
    drug, therapy = normalise.drugs(tables, cells)
    assert {(r.agentName, r.minDose, r.maxDose, r.duration, r.drugCategory) for r in drug.collect()} == {("Furosemide", "20 mg", "40 mg", "6 h", "diuretics"), ("Metolazone", "2 mg", "5 mg", "", "Thiazides")}
    assert [tuple(r) for r in therapy.collect()] == [("therapy_Thiazides", "pharmacological", "Thiazides")]
    assert [tuple(r) for r in normalise.recommendations(tables, cells).collect()] == [("rec_r_0", long)]
    assert [tuple(r) for r in normalise.stages(tables, cells).collect()] == [("stage_C", "ACC/AHA", "C", "Stage C", "structural")]
    assert [tuple(r) for r in normalise.phenotypes(tables, cells).collect()] == [("phenotype_HFrEF", "HFrEF", "<=40%")]
    assert [r.causeName for r in normalise.causes(tables, cells).collect()] == ["Ischemic heart disease"]
    assert [r.ae_id for r in normalise.harmful(tables, cells).collect()] == ["ae_NSAIDs"] and [r.therapyType for r in normalise.therapies(tables, cells).collect()] == ["device/procedure"]
    assert normalise.references(tables, cells, ("risk_score",)).first().payload == {"column_1": "b", "Score": "c"}
    assert [r.table_id for r in sinks.quarantine(tables, tables.where("role <> 'cause'")).collect()] == ["c"]


def test_single_row_recommendation(spark):
    head = "An implantable device is recommended for these patients"
    tables = spark.createDataFrame([("e", "recommendation", "", [head, "I", "A"])], "table_id string, role string, caption string, headers array<string>")
    cells = spark.createDataFrame([("e", 0, ["Another advice that is long enough to be one", "II", "B"]), ("e", 1, ["Not graded but long enough to be an advice", "text", ""])], "table_id string, row_no int, cells array<string>")
    assert sorted(r.rec_id for r in normalise.recommendations(tables, cells).collect()) == ["rec_e_0", "rec_e_h"]


def test_extractors(spark):
    b = spark.createDataFrame([
        (0, "Metoprolol is recommended in all patients with heart failure. Patients were assessed with exercise stress testing today. Side effects including hypotension and angioedema may occur."),
        (1, "Metoprolol may cause hypotension, such as orthostatic hypotension. Exercise stress testing gave LVEF <= 40 % of patients. Exercise stress testing was abnormal."),
        (2, "Class: HFrEF, NYHA class III and New York Heart Association class III. Caused by viral infection, long alcohol abuse. Catheter ablation helps; a Trial of catheter ablation did not. Beta-blocker therapy and oral anticoagulant agents."),
        (3, "Metoprolol is recommended in all patients with heart failure. Oral anticoagulant agents are used."), (4, None),
        (5, "Fitness was assessed with the six-minute walk test.")], "block long, text string")
    got = lambda df: {r.key: r.freq for r in df.collect()}
    assert got(extract.drugs(b)) == {"metoprolol": 3}
    assert not got(extract.adverse_events(b, 3))
    events = got(extract.adverse_events(b, 1))
    assert events["hypotension"] == 1 and events["orthostatic hypotension"] == 1
    assert got(extract.assessments(b, 1)) == {"sixminutewalktest": 1, "assessedwiththesixminutewalktest": 1}  # by cue and by noun; spans of eight or more letters and blanks alone are rejected, whatever their case
    hits = spark.createDataFrame([("k", "exercise stress testing"), ("n", "unseen")], "key string, span string")
    assert {r.key: r.value for r in extract.assessment_values(b, hits).collect()} == {"k": "<= 40 %", "n": ""}
    assert sorted((r.block, r.sent) for r in extract.recommendations(b).collect()) == [(0, 0), (2, 0)]  # one of two alike, and one that names a class
    assert got(extract.stages(b)) == {"nyha class iii": 1} and got(extract.phenotypes(b)) == {"hfref": 1, "lvef <= 40": 1} and got(extract.therapies(b)) == {"catheter ablation": 1, "beta blocker": 1, "oral anticoagulant": 1}
    assert "oral anticoagulant agents" in got(extract.mined_therapies(b)) and {"viral infection", "long alcohol abuse"} <= set(got(extract.causes(b)))


def test_guard_rails(spark):
    df = spark.createDataFrame([("Table 3 x",), ("Heart failure with fever",), ("viral infection",)], "t string")
    assert [r[0] for r in df.select(extract.must_reject("cause", F.col("t"), F.array(F.lit("heart failure")))).collect()] == [True, True, False]


def test_merge(spark):
    rows = spark.createDataFrame([(0, "g", "k", "drug_12", "Ab", "x", "unknown"), (1, "g", "k", "drug_1", "Abc", "text_mention", "A | unknown"), (2, "g", "k", "drug_9", "Abd", "y", "B"), (3, "g", "k", "", "Abcdef", "z", ""), (4, "g", "l", "d", None, None, "unknown")],
                                 "pos int, g string, key string, id string, name string, data string, scheme string")
    got = {r.key: r for r in merge.merge(rows, ["g", "key"], "id", "name", ["data", "scheme"], "pos", ("scheme",)).collect()}
    assert (got["k"].id, got["k"].name, got["k"].data, got["k"].scheme, got["k"].n) == ("drug_1", "Abc", "x | y", "A | B", 3)
    assert (got["l"].name, got["l"].data, got["l"].scheme) == ("", "", "unknown")


@pytest.mark.parametrize(("a", "b"), [("abc", "abd"), ("", ""), ("a", ""), ("kitten", "sitting"), ("heart failure", "failure of heart")])
def test_indel(a, b):
    def common(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert linking.indel(a, b) == pytest.approx(2 * common(a, b) / (len(a) + len(b)) if a or b else 1)


def test_linking_falls_back_to_either_token(spark):
    concepts = spark.createDataFrame([(1, "heart failure"), (2, "failure"), (3, "kidney stone"), (4, "other heart")], "concept int, label string")
    mentions = spark.createDataFrame([(1, "heart failure"), (2, "kidney heart"), (3, "nothing known"), (4, "failure failure")], "mention int, text string")
    got = {}
    for r in linking.candidates(mentions, "mention", "text", concepts, "concept", "label").collect():
        got.setdefault(r.mention, set()).add(r.concept)
    assert got[1] == {1} and got[2] == {3, 1, 4} and 3 not in got


def test_layout(spark):
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 100.0, 100.0)], "doc string, page int, width double, height double")
    rows = [("d", 1, i, 5.0 if i % 2 == 0 else 55.0, float(10 * i), 45.0 if i % 2 == 0 else 95.0, 10.0 * i + 5, f"t{i}") for i in range(10)] + [("d", 2, i, float(i), float(i), 50.0, i + 1.0, "u") for i in range(3)]
    b = spark.createDataFrame(rows, readers.BLOCK_SCHEMA)
    got = layout.reading_order(b, pages).where("page = 1").orderBy("place").collect()
    assert [r.block_no for r in got] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    assert {r.column for r in layout.reading_order(b, pages).where("page = 2").collect()} == {0}
    kept = spark.createDataFrame([("d", 1, 0, 0.0, 1.0, 50.0, 5.0, "Page 3"), ("d", 1, 1, 0.0, 40.0, 50.0, 45.0, "Running text of the page"), ("d", 1, 2, 0.0, 20.0, 5.0, 60.0, "MARGIN"), ("d", 1, 3, 0.0, 40.0, 50.0, 45.0, "see www.x.org")], readers.BLOCK_SCHEMA)
    assert [r.block_no for r in layout.kept_blocks(kept, pages).collect()] == [1]
    tables = spark.createDataFrame([("d", 1, "a", 100.0, 200.0), ("d", 1, "b", 600.0, 700.0), ("d", 1, "c", 5000.0, 5100.0)], "doc string, page int, table_id string, y0 double, y1 double")
    text = spark.createDataFrame([("d", 1, 0, 60.0, 90.0, "Table 1 Causes"), ("d", 1, 1, 560.0, 580.0, "as in table 2 below\nmore"), ("d", 1, 2, 500.0, 520.0, "and table 9 far\nmore")], "doc string, page int, block_no int, y0 double, y1 double, text string")
    assert {r.table_id: r.caption for r in layout.captions(tables, text).collect()} == {"a": "Table 1 Causes", "b": "as in table 2 below\nmore", "c": None}
    density = [0, 0, 0, 0.2, 0.2, 0.2, 0, 0, 0.2, 0.2, 0.2, 0.2]
    cut = spark.createDataFrame([("d", i + 1, False, float(x)) for i, x in enumerate(density)] + [("e", 1, False, 0.0), ("e", 2, True, 0.3), ("f", 1, False, 0.0)], "doc string, page int, heading boolean, density double")
    assert {r.doc: r.cut_page for r in layout.references_cut(cut).collect()} == {"d": 9, "e": 2}


def test_pages_of_blocks(spark):
    sizes = spark.createDataFrame([("d", 9, 100.0, 1000.0)], "doc string, page int, width double, height double")
    rows = [("d", 9, i, 5.0, 200.0 + 20 * i, 95.0, 210.0 + 20 * i, t) for i, t in enumerate(["The ﬁrst HF paragraph is long enough to stay on its page and goes on with", "treat-\nment of the second block that ends here with a stop.", "IV 2"])]
    got = blocks.pages(spark.createDataFrame(rows, readers.BLOCK_SCHEMA), sizes, acronyms={"HF": "heart failure"}).first()
    assert got.text == "The first heart failure paragraph is long enough to stay on its page and goes on with treatment of the second block that ends here with a stop."


def test_graph_units(spark):
    e = "http://x/entity/"
    rows = [
        ("s1", "http://x#verbatimText", 'A  "quoted"\ntext', False), ("s1", "http://x#hasClassOfRecommendation", "http://x/COR_III", True), ("s1", "http://x#hasLocator", "l", True), ("l", "http://x#headerPath", "Drugs", False),
        ("l", "http://x#headerPath", "Class IIa", False), ("s1", "http://x#hasExtractedEntity", "m1", True), ("s1", "http://x#hasExtractedEntity", "m2", True), ("m1", "http://x#surfaceForm", e + "serum%20K+", True), ("m2", "http://x#surfaceForm", "ACE", False)]
    g = spark.createDataFrame(rows, "s string, p string, o string, o_is_iri boolean")
    u = graph.units(graph.parsed(graph.rendered(g))).first()
    assert (u.text, u["class"], u.level, u.headers, u.entities) == ('A "quoted" text', ["III"], [], ["Drugs"], ["ACE", "serum K+"])
    lines = spark.createDataFrame([("<a> <b> .",), ('<a> <b> "x\\u00e9\\U0001"@en .',), ('<a> <b> "caf\\u00e9"^^<t> .',), ("",)], "line string")
    assert [r.o for r in graph.parsed(lines).where("o is not null").collect()] == ["café"]
    facts = spark.createDataFrame([("1", "This drug is given to all of the patients every day. 12", []), ("2", "This drug is given to all of the patients every day.", []), ("3", "ACE inhibitors and other blockers are clearly not recommended at all here.", ["III"])], "s string, text string, class array<string>")
    assert [r.s for r in graph.fact_index(facts).collect()] == ["1"]


def test_relations(spark):
    rel = spark.createDataFrame([("Statin", "Drug", "treats", "Heart failure", "Condition"), ("Heart failure", "Condition", "treats", "Statin", "Drug"), ("ICD", "Therapy", "treats", "x", "Stage"), ("a", "Stage", "treats", "b", "Stage")],
                                "subject string, subject_type string, relation string, object string, object_type string").select("*", F.monotonically_increasing_id().alias("position"), F.lit(1).alias("page"), F.lit("").alias("passage"))
    known = spark.createDataFrame([("s", "Drug", "Statin", 0), ("d", "Condition", "Default", 1), ("h", "Condition", "Heart failure", 2), ("i", "Therapy", "ICD", 3), ("x", "Stage", "x", 4), ("a", "Stage", "a", 5), ("b", "Stage", "b", 6)], "id string, kind string, name string, position int")
    recs = spark.createDataFrame([], "rec_id string, text string, position int")
    found = relations.relation_tables(rel, known, recs, ("S_treats",))["S_treats"]
    assert sorted(tuple(r) for r in found.collect()) == [("treats_step4_i", "d", "i", ""), ("treats_step4_s", "h", "", "s")]
    df = spark.createDataFrame([("A statin given daily may cause myalgia in some people. Other text.",)], "t string")
    assert df.select(relations.co_mentioned(F.col("t"), F.lit("Statin"), F.lit("myalgia")), relations.co_mentioned(F.col("t"), F.lit("statin"), F.lit("other"))).first() == (True, False)


def test_order(spark):
    e = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5, None), ("a", 3, None, "z")], "k string, pos int, v int, w string")
    assert order.first_wins(e, ["k"], ["pos"]).first() == ("a", 1, None, "x") and order.last_wins(e, ["k"], ["pos"]).first() == ("a", 3, None, "z")
    assert [r[0] for r in e.select(order.carry_forward(F.col("v"), ["k"], ["pos"]).alias("c"), "pos").orderBy("pos").collect()] == [None, 5, 5]


def test_models(spark):
    assert models.verdicts("1. KEEP\n2: reject\nx", 4) == [True, False, True, True]
    rows = spark.createDataFrame([(1, "short"), (2, "x" * 50), (3, None)], "id long, text string")
    assert {r.id: r.kept for r in models.validated(rows, "id", "text", models.LengthJudge(10)).collect()} == {1: True, 2: False, 3: True}
    assert models.json_span('<think>[1]</think> so: [{"a": 1}] ok') == [{"a": 1}] and models.json_span("[broken") is None
    assert models.relations('[{"subject":"a","subject_type":"Drug","relation":"treats","object":"b","object_type":"C"},{"relation":"likes"},3]', relations.RELATIONS)[0]["subject"] == "a"
    assert models.chosen_concept("it is C0018801.", ["C0018801"]) == ("C0018801", "disambiguated") and models.chosen_concept("C0000001", ["C0018801"])[0] is None
    best, value, log = models.search(["a", "bb", "ccc", "d"], len, lambda a, b: (a + b)[:8], lambda c: c + "!", 5)
    assert value == len(best) and log == sorted(log) and models.planned_calls(4, 2, 3, 5) == 3 + 12 + 18 + 10
    with pytest.raises(ValueError, match="even"):
        models.search(["a"], len, max, str, 1)
    cache = spark.createDataFrame([("k", "old", 0)], "key string, answer string, line_no int")
    asked = models.answered(spark.createDataFrame([("p",), ("p",)], "q string"), "q", cache, models.Scripted("yes")).collect()
    assert [r.answer for r in asked] == ["yes"]


def test_readers(spark, tmp_path):
    (tmp_path / "v.csv").write_text('﻿"CUI";Name;extra\nC1;" Heart ";x\nC2;;\n', encoding="utf-8")
    got = readers.vocabulary(spark, str(tmp_path / "v.csv")).collect()
    assert [(r.cui, r.label, r.definition, r.extra) for r in got] == [("C1", "Heart", "", "x"), ("C2", "", "", "")]
    (tmp_path / "bad.csv").write_text("cui,label\n,\n")
    with pytest.raises(ValueError, match="concept id"):
        readers.vocabulary(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "q.csv").write_text('a,b\n"x ""y""\nz",\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "q.csv")).collect()] == [('x "y"\nz', "")]
    assert readers.existing(spark, str(tmp_path / "no.csv"), "a string", readers.csv).count() == 0
    (tmp_path / "d.xml").write_text('<db><drug><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>x</drugbank-id><name>A-b</name></drug><drug><name>n</name></drug></db>')
    assert [tuple(r) for r in readers.drugs_xml(spark, str(tmp_path / "d.xml")).collect()] == [("DB1", "A-b")]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"key": k, "answer": a}) for k, a in (("k", "1"), ("k", "2"), ("l", "3"))) + "\nbroken")
    assert {r.key: r.answer for r in readers.call_cache(spark, str(tmp_path / "c.jsonl")).collect()} == {"k": "2", "l": "3"}
    names = spark.createDataFrame([("DB1", "A-b", 0), ("DB2", "ab", 1), ("", "c", 2)], "drug_id string, name string, pos int")
    assert [tuple(r) for r in readers.name_index(names, "pos").collect()] == [("ab", "DB1")]
    assert readers.turtle(":A a owl:Class ;\n rdfs:subClassOf :B .\n:p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B .") == [("A", "class", "B"), ("p", "object", "A>B")]
    key = readers.fingerprint(spark, str(tmp_path / "q.csv"))
    assert len(key) == 28 and readers.cached(spark, str(tmp_path / "cache"), key, lambda: names).count() == 3 and readers.cached(spark, str(tmp_path / "cache"), key, lambda: 1 / 0).count() == 3
    table = sinks.entity_table(spark, "S_cause", spark.createDataFrame([("c1", None)], "cause_id string, causeName string"), document="g1")
    assert [tuple(r) for r in table.collect()] == [("g1", "c1", "")] and sinks.entity_table(spark, "S_drug").columns[-1] == "drugCategory"
