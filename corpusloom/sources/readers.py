"""Readers: all columns are strings, a missing one is the empty string."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions import text as T

BLOCK_SCHEMA = "doc string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
PAGE_SCHEMA = "page int, source_file string, text string"
TABLE_SCHEMA = "table_id string, page int, source_file string, csv_path string, caption string, headers array<string>, row_count int"
#: Names that a concept table's columns may have.
ALIASES = {
    "cui": ("cui", "concept_id", "conceptid", "id", "umls_cui"), "label": ("label", "name", "str", "preferred_name", "term", "concept_name"),
    "semantic_type": ("semantic_type", "sty", "semtype", "type", "tui"), "definition": ("definition", "def", "description"),
}


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header; NUL characters removed, nulls as empty strings, short rows filled."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode="PERMISSIVE", sep=sep, nullValue="\x00none", emptyValue="")
    return rows.select(*(F.coalesce(F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit("")), F.lit("")).alias(c) for c in rows.columns))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cells array): the rows of a CSV without a header."""
    rows = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"', mode="PERMISSIVE")
    return rows.select(F.transform(F.array(*map(F.col, rows.columns)), lambda c: F.coalesce(c, F.lit(""))).alias("cells"))


def existing(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """`read(spark, path)`, or an empty table if there is nothing at the path."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return read(spark, path) if there else spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def call_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer): the last answer of a key in a file of JSON lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rows = lines.select("line_no", F.from_json("line", "key string, answer string").alias("r")).where("r.key is not null")
    return rows.groupBy("r.key").agg(F.max_by("r.answer", "line_no").alias("answer"))


def header_key(name: str) -> str:
    return name.replace("﻿", "").strip().strip("\"'").lower()


def sniffed(head: str) -> str:
    """The delimiter of a header line: the most frequent of comma, tab and semicolon."""
    line = head.replace("﻿", "").split("\n", 1)[0]
    return max(",\t;", key=lambda s: (line.count(s), -",\t;".index(s)))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(cui, label, semantic_type, definition, ...): a concept table whose header, delimiter and column names vary."""
    head = spark.read.text(path).limit(1).first()
    rows = csv(spark, path, sniffed(head[0] if head else ""))
    names = {header_key(c): c for c in rows.columns}
    out, used = [], set()
    for name, aliases in ALIASES.items():
        there = [names[a] for a in aliases if a in names]
        used |= set(there)
        out.append(F.coalesce(*(F.nullif(T.strip(F.col(f"`{c}`")), F.lit("")) for c in there), F.lit("")).alias(name))
    rest = [F.col(f"`{c}`").alias(k) for k, c in names.items() if c not in used]
    found = rows.select(*out, *rest)
    good = found.agg(F.count_if(F.col("cui") != "").alias("c"), F.count_if(F.col("label") != "").alias("l")).first()
    if not good["c"] or not good["l"]:
        raise ValueError(f"{path}: no row has a concept id and a label")
    return found


def fingerprint(spark: SparkSession, path: str, version: int = 1) -> str:
    """A key of a file's path, length and time, for the folder of a cached index."""
    files = spark.read.format("binaryFile").load(path).select(F.concat_ws(",", "path", "length", "modificationTime").alias("f"))
    return files.agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list("f")), F.lit(str(version))), 256)).first()[0][:28]


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The Parquet table `folder/key`, built if it can't be read."""
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception:  # any unreadable cache is a miss
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def drugs_xml(spark: SparkSession, path: str) -> DataFrame:
    """(drug_id, name) of <drug> elements with a primary id and a name."""
    rows = spark.read.format("xml").option("rowTag", "drug").schema(
        S.StructType([S.StructField("drugbank-id", S.ArrayType(S.StructType([S.StructField("_VALUE", S.StringType()), S.StructField("_primary", S.StringType())]))), S.StructField("name", S.StringType())])).load(path)
    primary = F.get(F.filter("drugbank-id", lambda x: x["_primary"] == "true"), F.lit(0))["_VALUE"]
    return rows.select(T.strip(T.filled(primary)).alias("drug_id"), T.strip(T.filled(F.col("name"))).alias("name")).where("drug_id <> '' and name <> ''")


def name_index(drugs: DataFrame, position: str) -> DataFrame:
    """(key, drug_id): the first id of each normalised name."""
    keyed = drugs.withColumn("key", T.letters_key(F.col("name"))).where("key <> '' and drug_id <> ''")
    return keyed.groupBy("key").agg(F.min_by("drug_id", position).alias("drug_id"))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(file, line)"""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def tolerant(content: Column) -> Column:
    """Text of bytes: UTF-8 with or without a mark, else Windows-1252."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(text, F.decode(content, "windows-1252")), "^﻿", "")


def documents_of(df: DataFrame, pattern: str) -> DataFrame:
    """`df` of files with `doc`: the part of the file's path that the pattern's group names."""
    return df.withColumn("doc", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def turtle(source: str) -> list[tuple[str, str, str]]:
    """(name, kind, detail) of the classes and properties of an ontology in Turtle: kind class, object or datatype; detail superclass or domain>range."""
    out = []
    for part in re.split(r"\s\.\s*(?:\n|$)", re.sub(r"(?m)^\s*#.*$", "", source)):
        subject = re.match(r"\s*(?:<[^>]*[/#]([^>/#]+)>|[\w-]*:([\w-]+))\s+(?:a|rdf:type)\s+owl:(Class|ObjectProperty|DatatypeProperty)", part)
        if subject:
            local = lambda p: (re.search(rf"rdfs:{p}\s+(?:<[^>]*[/#]([^>/#]+)>|[\w-]*:([\w-]+))", part) or [None, None, None])  # noqa: B023, E731
            name = lambda m: m[1] or m[2] or ""
            kind = {"Class": "class", "ObjectProperty": "object", "DatatypeProperty": "datatype"}[subject[3]]
            detail = name(local("subClassOf")) if kind == "class" else f"{name(local('domain'))}>{name(local('range'))}"
            out.append((name(subject), kind, detail))
    return sorted(out)
