r"""Quality rules: divergence from language references.

Base rules count words, word characters, symbols, repeated lines and words in
repeated 3-word windows. The method compares two histograms of a text with the
reference of its language: character classes, and common words (a fixed list
of function words for each language, and one cell for all other words). The
distance is the square root of the Jensen-Shannon divergence in bits, 0 to 1.

References are the sums over all documents of a language that pass the base
rules: characters for every language, words for those with a list. What comes
to the driver is a row for each language, at most `MAX_LANGUAGES` (those with
most documents). A text of no language is like no reference's and is compared
with none.

Guards: a histogram is only compared if the text has `MIN_CHARS` characters or
`MIN_WORDS` words, and the reference has `MIN_REFERENCE` documents; otherwise
that distance is null and decides nothing.

Null and empty texts: no words, base failed. Very long texts are counted whole.
Null languages: kept if the base rules are passed. Null ids and repeated rows: rows are independent.
Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import LOWER_BYTES, table

MIN_CHARS, MIN_WORDS, MIN_REFERENCE, MAX_LANGUAGES = 200, 50, 20, 1000
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.345
#: Function words by language.
COMMON = {
    "de": "der die das und in zu den von mit ist des im für auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split(),
    "en": "the of and to a in is it that was for on are as with his they be at one have this from or had by not but what all".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "other", "beyond")
_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
_STRIP = b".,;:!?\"'()"


def _class_of(b: int) -> int:
    if b >= 128:
        return 7
    c = chr(b)
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if b in _SPACE else 5 if c in ".,;:!?'\"()-" else 6


_CLASS = np.array([_class_of(b) for b in range(256)])


def measure(text: str | None, lang: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    kept = raw.translate(None, _SPACE)
    chars = len(kept) if kept.isascii() else len(kept.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        base = len(seen)
        if base < 2_000_000:
            keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:  # three ids no longer fit: number the pairs first
            _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
            keys = pair[:-1] * base + ids[2:]
        _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[where] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES)).tolist()
    common = COMMON.get(lang or "")
    cells = None
    if common:
        found = Counter(w.strip(_STRIP) for w in raw.translate(LOWER_BYTES).split())
        cells = [found.get(w.encode(), 0) for w in dict.fromkeys(common)]
        cells.append(n - sum(cells))
    return n, chars, symbols, dup, repeat, classes, cells


def measured(text: Column, lang: Column) -> Column:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"]

    @F.pandas_udf("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, common array<bigint>")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in batches:
            yield pd.DataFrame([measure(t, x) for t, x in zip(texts, langs, strict=True)], columns=names)

    return count(text, lang)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, in square roots of bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(counted: DataFrame, most: int = MAX_LANGUAGES) -> dict[str, tuple]:
    """Language to (documents, characters, words or None): sums over documents that pass the base rules."""
    k = max(len(set(v)) for v in COMMON.values()) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(k)]
    rows = counted.where(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = {}
    for r in rows.orderBy(F.desc("n"), "lang").limit(most).collect():
        size = len(set(COMMON.get(r["lang"], ()))) + 1
        words = np.array([r[f"w{i}"] for i in range(size)], float) if r["lang"] in COMMON else None
        out[r["lang"]] = (r["n"], np.array([r[f"c{i}"] for i in range(len(CLASSES))], float), words)
    return out


def distances(counted: DataFrame, refs: dict[str, tuple]) -> DataFrame:
    """`counted` with char_distance and word_distance."""

    def both(lang: str | None, n_words: int, classes: np.ndarray, common: np.ndarray | None) -> tuple:
        docs, chars, words = refs.get(lang, (0, None, None))
        near = far = None
        if docs >= MIN_REFERENCE:
            if classes.sum() >= MIN_CHARS:
                near = distance(classes, chars)
            if words is not None and common is not None and n_words >= MIN_WORDS:
                far = distance(common, words)
        return near, far

    @F.pandas_udf("char_distance double, word_distance double")
    def compare(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([both(*r) for r in zip(*rows, strict=True)], columns=["char_distance", "word_distance"], dtype="float64")

    found = counted.withColumn("__d", compare("lang", "n_words", "classes", "common"))
    return found.select(*counted.columns, "__d.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """(id, lang, the base counts, base_failed, char_distance, word_distance, kept) for every row."""
    counted = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), measured(F.col(text_col), F.col(lang_col).cast("string")).alias("m")).select("id", "lang", "m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = table(counted.withColumn("base_failed", failed))
    found = distances(counted, references(counted))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return found.withColumn("kept", ~F.col("base_failed") & near).drop("classes", "common").withColumnRenamed("id", id_col)
