"""Scores of written outputs: numbers, key points, readability, silence, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Number words, units, limits, refusals, names of everyone and of nothing, and the pattern of a quantity.
NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "hundred": 100, "one": 1,
}
UNITS = {
    "second": "second", "minute": "minute", "min": "minute", "hour": "hour", "hr": "hour", "day": "day", "week": "week", "month": "month", "year": "year",
    "time": "time", "gram": "g", "g": "g", "mg": "mg", "kg": "kg", "liter": "l", "litre": "l", "l": "l", "ml": "ml", "percent": "%", "%": "%",
}
DASHES = "-‐‑‒–—―"
LIMITS = {"title": 10, "narration": 35, "visual_description": 15, "on_screen_text": 8}
SENTENCE_LIMIT = 20
REFUSAL = r"(?i)\bI\s+(?:can(?:no|'|’)?t|can not|am unable|won(?:'|’)t)\b|\bI['’]m (?:not able|unable)\b"
EVERYONE = (
    "everyone", "everybody", "anyone", "all", "all patients", "all people", "you", "patients", "people",
    "people with heart failure", "patients with heart failure", "heart failure patients", "all heart failure patients",
)
NOTHING = ("", "none", "nothing", "null", "[]")
WEIGHTS = {"support": 2.0, "coverage": 1.0, "readability": 1.0, "format": 1.0}

_NUMBER = r"\d+(?:\.\d+)?|(?:" + "|".join(NUMBERS) + r")\b"
_UNIT = "|".join(sorted((f"{u}s?" if u.isalpha() else u for u in UNITS), key=len, reverse=True))
QUANTITY = rf"(?i)\b({_NUMBER})(?:\s*(?:[{DASHES}]|to)\s*({_NUMBER}))?(?:[\s{DASHES}]*({_UNIT})(?![a-z]))?"


def _map(table: dict) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))


def quantities(text: Column) -> Column:
    """Distinct array<struct<value double, unit string>>; a range gives both ends. A bare "one" is no number."""
    get = lambda i: F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(i))
    words = _map({k: float(v) for k, v in NUMBERS.items()})
    value = lambda n: F.coalesce(F.try_element_at(words, F.lower(n)), n.try_cast("double"))
    units = _map({u: v for k, v in UNITS.items() for u in ((k, f"{k}s") if k.isalpha() else (k,))})
    rows = F.arrays_zip(get(1).alias("low"), get(2).alias("high"), get(3).alias("unit"))
    rows = F.filter(rows, lambda r: ~((F.lower(r["low"]) == "one") & (r["unit"] == "")))

    def both(r: Column) -> Column:
        unit = F.try_element_at(units, F.lower(r["unit"]))
        ends = F.filter(F.array(r["low"], r["high"]), lambda n: F.coalesce(n, F.lit("")) != "")
        return F.transform(ends, lambda n: F.struct(value(n).alias("value"), unit.alias("unit")))

    return F.array_distinct(F.flatten(F.transform(rows, both)))


def unsupported(found: Column, allowed: Column) -> Column:
    """Quantities that no source states; without a unit any unit of the value will do."""
    same = lambda q: F.exists(allowed, lambda a: (a["value"] == q["value"]) & (q["unit"].isNull() | a["unit"].eqNullSafe(q["unit"])))
    return F.filter(found, lambda q: ~same(q))


def number_precision(found: Column, allowed: Column) -> Column:
    return F.when(F.size(found) == 0, 1.0).otherwise(1 - F.size(unsupported(found, allowed)) / F.size(found))


def normalized(text: Column) -> Column:
    """Lower case, units split from digits, dashes and slashes as spaces, number words as digits."""
    t = F.regexp_replace(F.lower(text), r"(\d)([a-z%])", "$1 $2")
    t = F.regexp_replace(F.replace(t, F.lit("%"), F.lit(" percent")), f"[{DASHES}/]", " ")
    for word, n in NUMBERS.items():
        if word != "one":
            t = F.regexp_replace(t, rf"\b{word}\b", str(n))
    return F.regexp_replace(t, r"\s+", " ")


def anchor_pattern(anchor: Column) -> Column:
    """A Java pattern of a normalised anchor: whole words with an optional plural, * for any ending."""
    words = F.split(F.trim(normalized(anchor)), " ")
    one = lambda w: F.when(w.endswith("*"), F.concat(F.lit(r"\Q"), F.substr(w, F.lit(1), F.length(w) - 1), F.lit(r"\E\w*"))).otherwise(F.concat(F.lit(r"\Q"), w, F.lit(r"\E(?:s|es)?")))
    return F.concat(F.lit(r"\b"), F.array_join(F.transform(words, one), " "), F.lit(r"\b"))


def key_points_said(text: Column, anchors: Column) -> Column:
    """array<boolean> for array<array<string>>: whether any anchor of a point stands in the text."""
    plain = normalized(text)
    return F.transform(anchors, lambda point: F.exists(point, lambda a: F.regexp_like(plain, anchor_pattern(a))))


def share_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x)) / F.size(flags)


def readability(fields: dict[str, Column]) -> Column:
    """1 - share of fields and sentences over their word limits; 1 if there is none."""
    long, every = F.lit(0), F.lit(0)
    for name, c in fields.items():
        there = c.isNotNull()
        if name in LIMITS:
            long = long + (there & (T.n_words(c) > LIMITS[name])).cast("int")
            every = every + there.cast("int")
        parts = T.pieces(c)
        long = long + F.size(F.filter(parts, lambda s: T.n_words(s) > SENTENCE_LIMIT))
        every = every + F.size(parts)
    return F.when(every == 0, 1.0).otherwise(1 - long / every)


def says_nothing(text: Column) -> Column:
    n = T.n_words(text)
    return (n < 3) | ((n < 60) & T.filled(text).rlike(REFUSAL))


def unless_silent(text: Column, score: Column) -> Column:
    return F.when(says_nothing(text), 0.0).otherwise(score)


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights[k] for k in scores)
    out = F.lit(0.0)
    for k, c in scores.items():
        out = out + c * weights[k]
    return out / total


def decide(box: Column, n_facts: Column) -> Column:
    """The label of a checklist: struct of strings medical_statement, fact, conflicts, states_it, same_people, fact_is_about, sentence_is_about and array added.

    An empty or unclear box counts against the sentence, but for
    medical_statement, where only a stated no makes NO_CLAIM.
    """
    word = lambda name: F.lower(F.trim(T.filled(box[name])))
    yes = lambda name: word(name).isin("true", "yes")
    group = lambda name: F.rtrim(F.regexp_replace(F.when(word(name) == "", "everyone").otherwise(word(name)), rf"[\s{DASHES}]+", " "), F.lit("."))
    number = F.when(word("fact").rlike(r"^\d+$"), word("fact").try_cast("int"))
    added = F.filter(F.coalesce(box["added"], F.array().cast("array<string>")), lambda a: ~F.lower(F.trim(T.filled(a))).isin(*NOTHING))
    everyone = (word("fact_is_about") != "") & group("fact_is_about").isin(*EVERYONE)
    return (
        F.when(word("medical_statement").isin("false", "no"), "NO_CLAIM")
        .when(~F.coalesce(number.between(1, n_facts), F.lit(False)), "NOT_SUPPORTED")
        .when(yes("conflicts"), "CONTRADICTED")
        .when(~yes("states_it") | (F.size(added) > 0) | ~(everyone | yes("same_people")), "NOT_SUPPORTED")
        .when(~everyone & group("sentence_is_about").isin(*EVERYONE), "NOT_SUPPORTED")
        .otherwise("SUPPORTED"))
