"""Passages and relations between entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.order import first_wins
from corpusloom.sources.shared import drop, table

#: The relations that are taken up.
RELATIONS = ("treats", "hasAdverseEvent", "evaluatedBy", "hasCause")


def entity_hits(sentences: DataFrame, sentence: str, text: str, entities: DataFrame, entity: str, name: str, least: int = 3) -> DataFrame:
    """(sentence, entity): whole-word, case-insensitive containment of names of `least` characters or more.

    A join on the name's first token and a check, not a comparison of all
    pairs; sentences and names are compared as token runs.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(T.filled(F.col(c))), F.lit("[a-z0-9]+"), F.lit(0))
    names = entities.where(F.length(F.col(name)) >= least).select(entity, runs(name).alias("n")).where("size(n) > 0")
    names = names.select(entity, F.get("n", F.lit(0)).alias("token"), F.concat(F.lit(" "), F.array_join("n", " "), F.lit(" ")).alias("needle"))
    said = sentences.select(sentence, runs(text).alias("s"))
    said = said.select(sentence, F.concat(F.lit(" "), F.array_join("s", " "), F.lit(" ")).alias("hay"), F.explode(F.array_distinct("s")).alias("token"))
    return said.join(names, "token").where(F.col("hay").contains(F.col("needle"))).select(sentence, entity).distinct()


def passages(sentences: DataFrame, sentence: str, text: str, entities: DataFrame, entity: str, name: str, least: int = 2, cap: int = 1500) -> DataFrame:
    """(sentence, text, entities): clean sentences with `least` entities or more."""
    clean = sentences.where(~T.is_noisy(F.col(text)))
    hits = entity_hits(clean, sentence, text, entities, entity, name)
    many = hits.groupBy(sentence).agg(F.array_sort(F.collect_set(entity)).alias("entities")).where(F.size("entities") >= least)
    return clean.select(sentence, F.substring(text, 1, cap).alias("text")).join(many, sentence)


def _grams(c: Column, n: Column) -> Column:
    """All substrings of n characters, each once; none of a shorter text."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, n)))).otherwise(F.array().cast("array<string>"))


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner.*, outer.*) of texts `i` that stand in texts `o`, anywhere, empty ones left out.

    A text meets those that have its rarest run of three characters (of all its
    characters, if it is shorter), and is then sought in them.
    """
    width = F.least(F.lit(3), F.length("i"))
    short = inner.where("i <> ''")
    runs = outer.select("*", F.explode(F.concat(*(_grams(F.col("o"), F.lit(w)) for w in (1, 2, 3)))).alias("__gram"))
    counts = runs.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    own = short.select("i", F.explode(_grams(F.col("i"), width)).alias("__gram")).distinct().join(counts, "__gram", "left")
    rarest = own.groupBy("i").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    return short.join(rarest, "i").join(runs, "__gram").where(F.contains("o", "i")).drop("__gram")


def holding(docs: DataFrame, id_col: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(id_col, item): each document with each item whose text stands in its text, anywhere.

    Only words with white space of the item on both sides are surely whole
    words of a document: an item meets the documents by its rarest one. Items
    without such a word meet, by their longest word, the words that hold it;
    those of white space only meet all documents. Texts are compared in full.
    Rows are told apart by hashes of their texts, so ids may repeat or be null.
    """
    words = lambda c: F.split(c, f"{T.SPACE}+")
    d = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("o"), F.xxhash64(text).alias("__to"))
    own = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("__item"), F.col(item_text).alias("i"), F.xxhash64(item_text).alias("__ti"))
    each = own.select("__ti", "i").distinct().withColumn("__w", words(F.col("i"))).withColumn("__whole", F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 2, F.lit(0))))
    said = d.select("__to", F.explode(F.array_distinct(words(F.col("o")))).alias("w"))
    whole = each.select("__ti", "i", F.explode(F.array_distinct("__whole")).alias("w"))
    there = said.join(whole.select("w").distinct(), "w", "left_semi")
    df = there.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rare = whole.join(df, "w", "left").groupBy("__ti", "i").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), F.col("w"))).alias("w")).select("__ti", "w")
    longest = lambda c: F.array_max(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    part = each.where(F.size("__whole") == 0).select("__ti", F.col("i").alias("all"), longest(F.col("__w")).alias("i"))
    some = F.broadcast(part.where("i <> ''").select(F.lit(1)).limit(1))  # one row; without it no words are collected
    every = said.crossJoin(some)
    held = within(part.select("__ti", "i"), every.select(F.col("w").alias("o")).distinct()).select("__ti", F.col("o").alias("w"))
    pairs = there.join(rare, "w").unionByName(every.join(held, "w").select("w", "__to", "__ti")).select("__to", "__ti").distinct()
    met = pairs.join(d, "__to").join(own, "__ti").where(F.contains("o", "i"))
    blank = d.join(F.broadcast(part.where("i = ''").select(F.col("all").alias("i")).distinct()), F.contains("o", "i")).join(own, "i")
    return met.select("__id", "__item").unionByName(blank.select("__id", "__item")).toDF(id_col, item)


def resolve(endpoints: DataFrame, key: str, entities: DataFrame, name: str, position: str, kind: str | None = None) -> DataFrame:
    """(key, name, how): the entity of that name, else the first whose name holds it or is held by it.

    kind: a column of both tables; the second step takes entities of the
    endpoint's kind only, of any if that is empty. It then returns (key, kind,
    name, how).
    """
    norm = lambda c: F.lower(T.strip(T.filled(F.col(c))))
    kinds = F.lower(T.filled(F.col(kind))) if kind else F.lit("")
    keys = [key, kind] if kind else [key]
    ends = endpoints.select(*keys, norm(key).alias("__k"), kinds.alias("__want")).where("__k <> ''").distinct()
    own = entities.select(F.col(name).alias("name"), norm(name).alias("__n"), F.col(position).alias("__p"), kinds.alias("__kind")).where("__n <> ''")
    exact = ends.join(own, F.col("__k") == F.col("__n")).groupBy(*keys, "__k", "__want").agg(F.min_by("name", "__p").alias("name"))
    rest = ends.join(exact, ["__k", "__want"], "left_anti").select("__k", "__want").distinct()
    side = own.select("name", "__n", "__p", "__kind")
    held = within(rest.withColumn("i", F.col("__k")), side.withColumn("o", F.col("__n")))
    holds = within(side.withColumn("i", F.col("__n")), rest.withColumn("o", F.col("__k")))
    cols = ["__k", "__want", "name", "__p", "__kind"]
    near = held.select(*cols).unionByName(holds.select(*cols)).where((F.col("__want") == "") | (F.col("__want") == F.col("__kind")))
    near = near.groupBy("__k", "__want").agg(F.min_by("name", "__p").alias("name"))
    part = ends.join(near, ["__k", "__want"]).select(*keys, "name")
    return exact.select(*keys, "name").withColumn("how", F.lit("exact")).unionByName(part.withColumn("how", F.lit("part")))


def best_overlap(left: DataFrame, lid: str, ltext: str, right: DataFrame, rid: str, rtext: str, on: list[str], least: float = 0.08) -> DataFrame:
    """(lid, rid, score): for each left row the right row of the same `on` with the largest Jaccard of tokens of three letters."""
    token = lambda c: F.array_distinct(T.tokens(F.col(c), 3))
    pairs = left.select(*on, lid, token(ltext).alias("__a")).join(right.select(*on, rid, token(rtext).alias("__b")), on)
    pairs = pairs.select(lid, rid, F.round(T.jaccard(F.col("__a"), F.col("__b")), 6).alias("score")).where(F.col("score") >= least)
    best = pairs.groupBy(lid).agg(F.min_by(F.struct(rid, "score"), F.struct(-F.col("score"), F.col(rid))).alias("__b"))
    return best.select(lid, "__b.*")


def mentioned(name: Column, text: Column) -> Column:
    """The name, or a token of it of three letters or more, stands in the text."""
    low = F.lower(T.filled(text))
    return low.contains(F.lower(name)) | F.exists(T.tokens(name, 3), lambda t: low.contains(t))


def co_mentioned(passage: Column, a: Column, b: Column) -> Column:
    """Both names are mentioned in the passage and in one of its sentences of over 30 characters."""
    return mentioned(a, passage) & mentioned(b, passage) & F.exists(T.passages(passage), lambda s: mentioned(a, s) & mentioned(b, s))


def page_of(rec_id: Column) -> Column:
    """The page in a recommendation's id; null if it has none."""
    return F.nullif(F.regexp_extract(T.filled(rec_id), r"_p(\d+)_", 1), F.lit("")).cast("int")


def bound(relations: DataFrame, keys: list[str], recommendations: DataFrame, least: float = 0.08) -> DataFrame:
    """(keys, rec_id): for each relation (keys, page, passage, names) the recommendation (rec_id, text, position) of its page that mentions all names and is most like the passage.

    Distinct names, not relations, meet the texts of their page, and distinct
    passages those that mention their names. Of equal texts of a page the first
    stands for all, for none of the others can win.
    """
    recs = recommendations.select("rec_id", F.col("position").alias("__place"), page_of(F.col("rec_id")).alias("page"), F.lower(T.strip(T.filled(F.col("text")))).alias("__low")).where("page is not null and __low <> ''")
    recs = recs.groupBy("page", "__low").agg(F.min_by(F.struct("rec_id", "__place"), "__place").alias("r")).select("page", "__low", "r.*", F.array_distinct(T.tokens(F.col("__low"), 3)).alias("__b"))
    said = relations.select("page", "names", "passage").distinct()
    # each name with its tokens, once for each page and name
    needles = F.transform("names", lambda n: F.concat(F.array(F.lower(n)), T.tokens(n, 3)))
    names = said.select("page", "names").distinct().withColumn("__needles", needles)
    fits = names.join(recs, "page").where(F.forall("__needles", lambda needle: F.exists(needle, lambda t: F.contains(F.col("__low"), t)))).select("page", "names", "rec_id", "__place", "__b")
    pairs = said.withColumn("__a", F.array_distinct(T.tokens(F.col("passage"), 3))).join(fits, ["page", "names"])
    scored = pairs.select("page", "names", "passage", "rec_id", "__place", T.jaccard(F.col("__a"), F.col("__b")).alias("__s")).where(F.col("__s") >= least)
    best = scored.groupBy("page", "names", "passage").agg(F.min_by(F.struct("rec_id", "__place", "__s"), F.struct(-F.col("__s"), F.col("__place"))).alias("__r"))
    return relations.join(best, ["page", "names", "passage"]).groupBy(*keys).agg(F.min_by("__r.rec_id", F.struct(-F.col("__r.__s"), F.col("__r.__place"))).alias("rec_id"))


def resolved(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """`relations` (position, relation, subject, subject_type, object, object_type, page, passage) whose two ends are known, as structs s and o (id, kind, name).

    entities: (id, kind, name, position), one for each lower-cased name. The
    result is a written table: as a plan alone, each use of it computes all
    relations and searches all ends again, and so does each use of its parts.
    """
    side = lambda c: F.struct(F.col(c).alias("end"), F.col(f"{c}_type").alias("kind"))
    ends, entities = table(relations.select(F.inline(F.array(side("subject"), side("object")))).distinct()), table(entities)
    known = table(resolve(ends, "end", entities, "name", "position", "kind").select("end", F.col("kind").alias("as_kind"), "name").join(entities.select("name", F.struct("id", "kind", "name").alias("e")), "name").select("end", "as_kind", "e"))
    end = lambda c: known.select(F.col("end").alias(c), F.col("as_kind").alias(f"{c}_type"), F.col("e").alias(c[0]))
    found = table(relations.join(end("subject"), ["subject", "subject_type"]).join(end("object"), ["object", "object_type"]))
    drop(ends, entities, known)
    return found


def _as(kind: str, first: str = "s", then: str = "o") -> Column:
    """The end of a kind: of the subject or, if it is of another, of the object (or the other way round)."""
    return F.when(F.col(f"{first}.kind") == kind, F.col(first)).when(F.col(f"{then}.kind") == kind, F.col(then))


#: The relations that each table is made of.
SOURCES = {"S_treats": ("treats",), "S_recommendation": ("treats", "hasAdverseEvent"), "S_drug_adverse_event": ("hasAdverseEvent",), "S_condition_assessment": ("evaluatedBy",), "S_condition_cause": ("hasCause",)}
TABLES = tuple(SOURCES)


def relation_tables(relations: DataFrame, entities: DataFrame, recommendations: DataFrame, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Tables by name of the four relations, ends put right by kind, each key once (the first by position), and of the recommendations that say them.

    A missing condition is the first one known, or "Unknown".
    """
    found = resolved(relations.where(F.col("relation").isin(*{r for name in names for r in SOURCES[name]})), entities)
    default = entities.agg(F.min_by("id", F.when(F.col("kind") == "Condition", F.col("position"))).alias("default")).select(F.coalesce("default", F.lit("Unknown")).alias("default"))
    of = lambda relation: found.where(F.col("relation") == relation).crossJoin(F.broadcast(default))  # noqa: E731  (one row)
    condition = lambda first, then: F.coalesce(_as("Condition", first, then)["id"], F.col("default")).alias("condition_id")
    kept = ["position", "page", "passage"]
    ids = [F.col("d.id").alias("drug_id"), F.col("a.id").alias("ae_id")]

    def treats() -> DataFrame:
        therapy = F.when(F.col("s.kind").isin("Therapy", "Drug"), F.col("s")).otherwise(F.col("o"))
        id_if = lambda kind: F.when(F.col("t.kind") == kind, F.col("t.id")).otherwise("")
        rows = of("treats").select(*kept, condition("o", "s"), therapy.alias("t"))
        rows = rows.select(*kept, "condition_id", id_if("Therapy").alias("therapy_id"), id_if("Drug").alias("drug_id"), "t").where("therapy_id <> '' or drug_id <> ''")
        return first_wins(rows, ["condition_id", "therapy_id", "drug_id"], ["position"])

    def harms() -> DataFrame:
        rows = of("hasAdverseEvent").select(*kept, "default", _as("Drug").alias("d"), _as("AdverseEvent", "o", "s").alias("a")).where("d is not null and a is not null")
        return rows.where(co_mentioned(F.col("passage"), F.col("d.name"), F.col("a.name")))

    def said() -> DataFrame:
        rows = treats().select(*kept, "condition_id", "therapy_id", "drug_id", F.lit("").alias("ae_id"), F.array("t.name").alias("names"))
        rows = rows.unionByName(harms().select(*kept, F.col("default").alias("condition_id"), F.lit("").alias("therapy_id"), *ids, F.array("d.name", "a.name").alias("names")))
        best = bound(rows, ["position", "condition_id", "therapy_id", "drug_id", "ae_id"], recommendations)
        return first_wins(best, ["rec_id", "therapy_id", "drug_id", "ae_id"], ["position"])

    def pairs(relation: str, kind: str, name: str) -> DataFrame:
        return of(relation).select(condition("s", "o"), _as(kind, "o", "s")["id"].alias(name)).where(F.col(name).isNotNull()).distinct()

    build = {
        "S_treats": lambda: treats().select(F.concat(F.lit("treats_step4_"), F.col("t.id")).alias("treats_id"), "condition_id", "therapy_id", "drug_id"),
        "S_recommendation": lambda: said().select("rec_id", "condition_id", "therapy_id", "drug_id", "ae_id"),
        "S_drug_adverse_event": lambda: harms().select(*ids).distinct(),
        "S_condition_assessment": lambda: pairs("evaluatedBy", "Assessment", "assessment_id"),
        "S_condition_cause": lambda: pairs("hasCause", "Cause", "cause_id"),
    }
    return {name: build[name]() for name in names}


def type_counts(entities: DataFrame) -> DataFrame:
    """(kind, n)"""
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def longest_first(names: Column) -> Column:
    """An array of names, the longest first, as it was among those of a length."""
    numbered = F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("i"), n.alias("n")))
    return F.transform(F.array_sort(numbered), lambda x: x["n"])


def report(passages: DataFrame, relations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): passages, relations and the rows of each table."""
    rows = {"passages": passages, "relations": relations} | tables
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in rows.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
