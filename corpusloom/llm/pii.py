r"""Personal data: patterns propose spans, validators confirm them, context adjusts the score.

Kinds of the base: email, ip, card (Luhn), phone. Added: iban (mod-97), ssn
(needs a context word). Spans of a kind are leftmost and don't overlap; a
match that fails its validator is dropped. Starts and ends count code points.

A pattern is run twice over a text, as `split` and as `regexp_extract_all`;
the lengths of the pieces and of the matches add up to the places. Loops over
groups are possessive, which Java runs without recursion, and a local part
only begins where a run of its characters begins (or the last match ended), so
a long run costs one pass.

All is DataFrame functions, one row at a time: no shuffle, no Python.

The context of a span reaches to the next match of its kind at most.

Null and empty texts have no spans. Very long texts are scanned whole. Rows
are independent: repeated rows, null ids and empty tables need no rule. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm._common import running as _running

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Java patterns by kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that holds wherever the pattern matches.
HINTS = {"email": "@", "phone": "+"}
#: Words that speak for a kind, sought in the `NEAR` characters on both sides.
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|bank|account", "ssn": "ssn|social security",
}
NEAR = 40
#: Score of a confirmed span without and with a context word; spans under `LEAST` are not reported.
SCORES = {"email": (0.8, 0.95), "ip": (0.6, 0.9), "card": (0.7, 0.95), "phone": (0.6, 0.9), "iban": (0.8, 0.95), "ssn": (0.3, 0.8)}
LEAST = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN leaves the remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        n = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
        return F.when(n > 9, (rest * 100 + n) % 97).otherwise((rest * 10 + n) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>"


def kind_spans(text: Column, kind: str) -> Column:
    """The spans of one kind: array<struct<start, rank, end, kind, value, score>>."""
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]")
    plain, backed = SCORES[kind]

    def located(x: Column) -> Column:
        pieces, found = x["pieces"], x["found"]
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))

        def span(m: Column, i: Column, begins: Column) -> Column:
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            start = F.get(begins, i) + F.length(before)
            near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
            score = F.when(near.rlike(CONTEXT[kind]), backed).otherwise(plain)
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"), score.alias("score"))

        every = _let(_running(lengths), lambda begins: F.transform(found, lambda m, i: span(m, i, begins)))
        return F.filter(every, lambda s: confirmed(kind, s["value"]) & (s["score"] >= LEAST))

    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("pieces"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"))
    found = _let(both, lambda x: F.when(F.size(x["found"]) > 0, located(x)))
    return F.coalesce(F.when(hint, found), F.array().cast(_SPANS))


def spans(text: Column, kinds: tuple = KINDS) -> Column:
    """All spans of a text in the order of start, then kind: array<struct<start, rank, end, kind, value, score>>."""
    return F.array_sort(F.concat(*(kind_spans(text, k) for k in kinds)))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span's value replaced by its kind in brackets; of overlapping spans the first."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        then = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], then).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
