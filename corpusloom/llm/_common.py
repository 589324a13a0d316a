"""Helpers shared by the operators: shared tables, row keys and UDF plumbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import drop, shared_dir, table  # noqa: F401  (the operators take them from here)

#: Java pattern of a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for bytes: `bytes.split()` cuts at exactly the white space of WORD.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


PART = 1 << 17


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of short rows and about `rows` of them, in tasks of some PART rows: a small table behind a shuffle is a few files, not one a partition."""
    return df.coalesce(1 + rows // PART)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_CHUNK = 256


def running(lengths: Column) -> Column:
    """Sums of all elements before each; in chunks, so that growing an array stays cheap."""
    zero = F.lit(0).cast("long")
    n = F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")
    chunk = lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))

    def grow(parts: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(parts, empty, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    sums = F.transform(F.sequence(F.lit(0), n), lambda c: F.aggregate(chunk(c), zero, lambda a, x: a + x))
    begins = grow(sums, zero)
    return F.flatten(F.transform(begins, lambda at, c: grow(chunk(c), at)))


def parted(docs: DataFrame, own: tuple[Column, ...], keys: DataFrame, theirs: tuple[Column, ...], bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """`docs` as (rows whose key is surely not in `keys`, the others).

    Only a hash of `bits` bits of each key is broadcast, a row for each hash
    at most, so texts that need no join with `keys` aren't shuffled for it.
    Few rows too many among the others only cost their shuffle.
    """
    cell = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(1 << bits)).cast("int")
    (name,) = fresh(docs, "__cell")
    cells = F.broadcast(table(few(keys.select(cell(theirs).alias(name)).distinct(), 1 << bits)))
    mine = docs.withColumn(name, cell(own))
    return mine.join(cells, name, "left_anti").select(*docs.columns), mine.join(cells, name, "left_semi").select(*docs.columns)
