"""Entity merge: one row for each group of a semantic key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SEPARATOR = " | "


def longest(value: str, position: str) -> Column:
    """The longest value of a group, the first on a tie."""
    kept = F.when(T.filled(F.col(value)) != "", F.col(value))
    return T.filled(F.min_by(kept, F.when(kept.isNotNull(), F.struct(-F.length(kept), F.col(position)))))


def shortest(value: str, position: str) -> Column:
    kept = F.when(T.filled(F.col(value)) != "", F.col(value))
    return T.filled(F.min_by(kept, F.when(kept.isNotNull(), F.struct(F.length(kept), F.col(position)))))


def _in_order(value: str, position: str) -> Column:
    """A group's values by position. collect_set of (value, first place) would need two steps; groups are spellings of one entity."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), T.filled(F.col(value)).alias("v")))), lambda x: x["v"])


def joined(value: str, position: str) -> Column:
    """Distinct values in order, joined; empty ones and the mark `text_mention` left out."""
    kept = F.filter(F.transform(_in_order(value, position), T.strip), lambda v: (v != "") & (v != "text_mention"))
    return F.array_join(F.array_distinct(kept), SEPARATOR)


def joined_schemes(value: str, position: str) -> Column:
    """The same for values that are lists already; `unknown` only if nothing else is there."""
    parts = F.flatten(F.transform(_in_order(value, position), lambda v: F.split(v, r"\|")))
    parts = F.array_distinct(F.filter(F.transform(parts, T.strip), lambda v: v != ""))
    known = F.filter(parts, lambda v: F.lower(v) != "unknown")
    return F.array_join(F.when(F.size(known) > 0, known).otherwise(parts), SEPARATOR)


def canonical_id(kind: str, id_col: Column, name: Column) -> Column:
    """The cleaned id, else one made of the name, else empty."""
    given = F.replace(T.strip(T.filled(id_col)), F.lit(f"{kind}_txt_"), F.lit(f"{kind}_"))
    plain = T.strip(T.filled(name))
    return F.when(given != "", given).when(plain != "", F.concat(F.lit(f"{kind}_"), T.underscored(plain))).otherwise("")


def grouping_key(kind: str, canonical: Column, whole: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> Column:
    prefix = f"{kind}_"
    bare = F.when(F.lower(canonical).startswith(prefix), F.substr(canonical, F.lit(len(prefix) + 1))).otherwise(canonical)
    key = T.norm_key(bare)
    return F.concat(F.lit(prefix), T.abbreviation(key, whole or {}, suffixes or {}))


def stage_key(scheme: Column, level: Column, name: Column, fallback: Column) -> Column:
    s, lv, n = T.norm_key(F.replace(T.filled(scheme), F.lit("/"), F.lit("_"))), T.norm_key(level), T.norm_key(name)
    return (
        F.when((lv != "") & (s == "nyha"), F.concat(F.lit("stage_"), s, F.lit("_"), lv))
        .when(lv != "", F.concat(F.lit("stage_"), lv)).when(n != "", F.concat(F.lit("stage_"), n)).otherwise(fallback))


def merge(rows: DataFrame, keys: list[str], id_col: str, name_col: str, data_cols: list[str], position: str, scheme_cols: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, name, data..., n): shortest id, longest name, joined data; rows without id dropped."""
    kept = rows.where(T.filled(F.col(id_col)) != "")
    data = [(joined_schemes if c in scheme_cols else joined)(c, position).alias(c) for c in data_cols]
    return kept.groupBy(*keys).agg(shortest(id_col, position).alias(id_col), longest(name_col, position).alias(name_col), *data, F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position"))
