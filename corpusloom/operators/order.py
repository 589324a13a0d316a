"""Order-dependent operators: which row wins is always said by a position column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """One row a key, the first by position. A minimum of whole rows, so that tasks combine before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *position)]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*position, *rest), F.struct(*position)).alias("__row"))
    return found.select(*keys, "__row.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, *position)]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*position, *rest), F.struct(*position)).alias("__row"))
    return found.select(*keys, "__row.*").select(*df.columns)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, position: list[str]) -> DataFrame:
    """(keys, value, n): the most frequent value of a key, the one seen first on a tie."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*position)).alias("__at"))
    best = counted.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("__at"))).alias("__row"))
    return best.select(*keys, "__row.*")


def carry_forward(value: Column, keys: list[str], position: list[str]) -> Column:
    """The last value that isn't null so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*position).rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, keys: list[str], position: str, flag: Column, least: int) -> DataFrame:
    """(keys, island_start, island_end, n): runs of `least` or more neighbouring rows whose flag holds; position without gaps in its order."""
    order = Window.partitionBy(*keys).orderBy(position)
    rows = df.select(*keys, position, flag.alias("__flag"), F.row_number().over(order).alias("__i")).where("__flag")
    rows = rows.withColumn("__isle", F.col("__i") - F.row_number().over(order))
    runs = rows.groupBy(*keys, "__isle").agg(F.min(position).alias("island_start"), F.max(position).alias("island_end"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).drop("__isle")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
