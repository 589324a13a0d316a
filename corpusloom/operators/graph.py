"""Triples: mapping tables, union, rendering and reading N-Triples, facts by self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: A line of N-Triples, as a Java pattern of subject, predicate, object node, literal, suffix.
LINE = r'^<([^>]+)> <([^>]+)> (?:<([^>]+)>|"((?:[^"\\]++|\\.)*+)"(@\w+|\^\^<[^>]+>)?) \.$'


def iri(base: str, kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{base}/{kind}/"), F.url_encode(key.cast("string")))


def triples(rows: DataFrame, subject: Column, literals: dict[str, Column], nodes: dict[str, Column], base: str) -> DataFrame:
    """(s, p, o, o_is_iri): one triple for each property that isn't empty, from one pass over the rows."""
    cells = [F.struct(F.lit(f"{base}#{p}").alias("p"), c.cast("string").alias("o"), F.lit(False).alias("o_is_iri")) for p, c in literals.items()]
    cells += [F.struct(F.lit(f"{base}#{p}").alias("p"), c.alias("o"), F.lit(True).alias("o_is_iri")) for p, c in nodes.items()]
    return rows.select(subject.alias("s"), F.explode(F.array(*cells)).alias("x")).select("s", "x.*").where("o is not null and o <> ''")


def merged(*graphs: DataFrame) -> DataFrame:
    """The set union of graphs."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(graph: DataFrame) -> DataFrame:
    """(line): N-Triples."""
    node = F.concat(F.lit("<"), F.col("o"), F.lit(">"))
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    return graph.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), F.when(F.col("o_is_iri"), node).otherwise(literal), F.lit(" .")).alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_is_iri) of N-Triples lines; lines of another form are skipped."""
    line = T.strip(F.col("line"))
    get = lambda i: F.regexp_extract(line, LINE, i)
    long = F.regexp_replace(get(4), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    literal = F.get_json_object(F.concat(F.lit('{"v":"'), long, F.lit('"}')), "$.v")
    node = get(3) != ""
    return lines.where(line.rlike(LINE)).select(get(1).alias("s"), get(2).alias("p"), F.when(node, get(3)).otherwise(literal).alias("o"), node.alias("o_is_iri"))


def local_name(c: Column) -> Column:
    return F.element_at(F.split(c, "[/#]"), -1)


def surface(c: Column) -> Column:
    """The percent-decoded tail of an entity's IRI; + stays."""
    return F.url_decode(F.replace(F.substring_index(c, "/entity/", -1), F.lit("+"), F.lit("%2B")))


def units(graph: DataFrame) -> DataFrame:
    """(s, text, class, level, headers, entities): each sentence of a graph with its grades, headers and entities."""
    g = graph.select("s", local_name(F.col("p")).alias("p"), "o", "o_is_iri")
    has = lambda name, node: g.where((F.col("p") == name) & (F.col("o_is_iri") == F.lit(node)))
    texts = has("verbatimText", False).groupBy("s").agg(F.min("o").alias("text")).select("s", T.squeeze(F.col("text")).alias("text"))
    grade = lambda name, out: has(name, True).groupBy("s").agg(F.array_sort(F.collect_list(F.substring_index("o", "_", -1))).alias(out))
    heads = has("hasLocator", True).select("s", F.col("o").alias("loc")).join(has("headerPath", False).select(F.col("s").alias("loc"), F.col("o").alias("h")), "loc")
    heads = heads.where(~F.col("h").rlike(r"^(?:Class|Level|COR|LOE)\b")).groupBy("s").agg(F.array_sort(F.collect_list("h")).alias("headers"))
    forms = has("surfaceForm", False).select("s", "o").unionByName(has("surfaceForm", True).where(F.col("o").contains("/entity/")).select("s", surface(F.col("o")).alias("o")))
    ents = has("hasExtractedEntity", True).select("s", F.col("o").alias("e")).join(forms.select(F.col("s").alias("e"), "o"), "e")
    ents = ents.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("entities"))
    out = texts
    for side in (grade("hasClassOfRecommendation", "class"), grade("hasLevelOfEvidence", "level"), heads, ents):
        out = out.join(side, "s", "left")
    none = F.array().cast("array<string>")
    return out.select("s", "text", *(F.coalesce(c, none).alias(c) for c in ("class", "level", "headers", "entities")))


def without_group(text: Column, classes: Column) -> Column:
    """A statement of class III that doesn't say for whom."""
    third = F.exists(classes, lambda c: (c == "III") | c.startswith("3"))
    group = r"(?i)\b(?:in|for|among|with)\s+(?:\w+\s+){0,2}(?:patients|women|people|adults|children|pregnan\w*|individuals|persons|those)\b"
    return third & ~text.rlike(group)


def fact_index(found: DataFrame) -> DataFrame:
    """Units that state a fact for all or for a named group, the first of each text that differs only in trailing numbers."""
    key = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[\d\s,–\-]+$", ""), "[^a-z]", "")
    kept = found.where(T.is_fact(F.col("text")) & ~without_group(F.col("text"), F.col("class"))).withColumn("__key", key)
    return kept.groupBy("__key").agg(F.min_by(F.struct(*found.columns), "s").alias("u")).select("u.*")
