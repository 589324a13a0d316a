"""Text as Columns: cleaning, tokens, sentences, keys and predicates. All stays in the JVM.

A missing string is the empty string here, as in the tables this engine keeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"
#: Words that may not stand at the edges of a mined phrase.
TRAILING = "and|or|with|for|of|in|the|a|an|to|is|are|was|were|by|at|on|from|due|has|have|had|that|which|who|also|but|not|as|if|than|into"
LEADING = "and|or|with|for|of|in|the|a|an|to|is|are|was|were|by|at|on|from|due|that|which|who|also|but|not|as|if|than|into"
#: Search stop words.
STOP = (
    "a an the and or of to in on for with without by is are be been being as at from that this these those it its "
    "their there than then into can may should not no any all each other such per who which when how what why "
    "patients patient recommended considered reduce risk create brief education scene explains explain simple "
    "words people person help helps used use using also more less over between during after before both "
    "work works protect protects dangerous checked check first developed example mean means affect affects "
    "happen happens important regular regularly keep get getting introduce introduces give gives list lists"
).split()


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def dehyphenate(c: Column) -> Column:
    """Joins a word cut by a hyphen at a line's end."""
    return F.regexp_replace(c, rf"([A-Za-z])-\n{SPACE}*([A-Za-z])", "$1$2")


def join_lines(c: Column, glue: str = "") -> Column:
    """Joins letters or digits on both sides of a line break, by default without a space."""
    return F.regexp_replace(c, rf"([A-Za-z0-9])\n{SPACE}*([A-Za-z0-9])", f"$1{glue}$2")


def without_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\t\r]]", "")


def clean_block(c: Column, glue: str = "") -> Column:
    """The order of cleaning a block: control characters, hyphens, line joins, white space. NFKC is `sources.blocks.nfkc`."""
    plain = without_control(F.replace(c, F.lit(" "), F.lit(" ")))
    return squeeze(join_lines(dehyphenate(plain), glue))


def expand(c: Column, table: dict[str, str], longest_first: bool = False) -> Column:
    """Whole-word replacement, entry after entry, in the table's order or longest key first."""
    keys = sorted(table, key=len, reverse=True) if longest_first else list(table)
    return reduce(lambda x, k: F.regexp_replace(x, rf"\b\Q{k}\E\b", table[k].replace("\\", "\\\\").replace("$", r"\$")), keys, c)


def strip_edges(c: Column) -> Column:
    """Up to five rounds of one filler word off the end and one off the start, then punctuation."""
    for _ in range(5):
        c = strip(F.regexp_replace(c, rf"(?i){SPACE}+(?:{TRAILING}){SPACE}*$", ""))
        c = strip(F.regexp_replace(c, rf"(?i)^(?:{LEADING}){SPACE}+", ""))
    return F.btrim(c, F.lit(" ,;:.()"))


def underscored(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_"))


def slug(c: Column, cap: int = 80, back_off: int = 40) -> Column:
    """An identifier of a text; a long one ends at its last underscore beyond `back_off`."""
    s = underscored(strip(filled(c)))
    head = F.substring(s, 1, cap)
    at = cap + 1 - F.instr(F.reverse(head), "_")
    cut = F.when(F.contains(head, F.lit("_")) & (at - 1 > back_off), F.substr(head, F.lit(1), at - 1)).otherwise(head)
    out = F.when(F.length(s) <= cap, s).otherwise(F.btrim(cut, F.lit("_")))
    return F.when(out == "", "unknown").otherwise(out)


def norm_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(filled(c))), "[^a-z0-9]+", "_"), F.lit("_"))


def letters_key(c: Column) -> Column:
    """Only letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "")


def abbreviation(key: Column, whole: dict[str, str], suffixes: dict[str, str]) -> Column:
    """A key that is an abbreviation as a whole is expanded, else its abbreviated suffix."""
    out = key
    for suffix, longer in reversed(suffixes.items()):
        out = F.when(key.endswith(suffix), F.concat(F.substr(key, F.lit(1), F.length(key) - len(suffix)), F.lit(longer))).otherwise(out)
    for short, longer in whole.items():
        out = F.when(F.replace(key, F.lit("_"), F.lit("")) == short, norm_key(F.lit(longer))).otherwise(out)
    return out


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.regexp_extract_all(F.lower(filled(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def search_words(c: Column) -> Column:
    """Tokens for retrieval: plural acronyms and long plurals cut, stop words out (before the cut)."""
    plain = F.regexp_replace(filled(c), r"\b([A-Z][A-Z0-9]+)s\b", "$1")
    found = F.regexp_extract_all(F.translate(F.lower(plain), "-/", "  "), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(STOP))
    return F.transform(kept, lambda t: F.when((F.length(t) > 4) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))


_MARK = "\x01"


def sentences(c: Column) -> Column:
    """Sentences of squeezed text, cut after . ! ? ; before a space."""
    marked = F.regexp_replace(squeeze(filled(c)), r"([.!?;]) +", f"$1{_MARK}")
    return F.filter(F.split(marked, _MARK), lambda s: s != "")


def passages(c: Column, least: int = 30) -> Column:
    """Sentences by paragraph, cut after . ! ? before a capital or digit; longer than `least`."""
    paragraphs = F.split(filled(c), r"\n\s*\n")
    marked = F.transform(paragraphs, lambda p: F.regexp_replace(squeeze(p), r"([.!?]) +(?=[A-Z0-9])", f"$1{_MARK}"))
    return F.filter(F.flatten(F.transform(marked, lambda p: F.split(p, _MARK))), lambda s: F.length(s) > least)


def pieces(c: Column) -> Column:
    """Sentences of an output: after . ! ?, at line breaks and at a JSON key; with a letter or digit."""
    marked = F.regexp_replace(filled(c), r"(?<=[.!?])[\"')\]},]*\s+|\"[\w -]{1,30}\"\s*:|\\n|\n", _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def n_words(c: Column) -> Column:
    t = squeeze(filled(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


# Predicates on blocks of text.

def is_url(c: Column) -> Column:
    return c.rlike(r"(?i)https?://\S+|doi:\s*\S+|www\.\S+|downloaded from|accessed on|retrieved from")


def is_contents(c: Column) -> Column:
    """A line of a table of contents."""
    page = c.rlike(r"\b\d{1,4}\s*$")
    dotted, numbered = c.rlike(r"\.{3,}"), c.rlike(r"^\d+(?:\.\d+)+")
    return (c != "") & (F.length(c) <= 220) & page & (dotted | (numbered & (n_words(c) <= 18)))


def is_metadata(c: Column) -> Column:
    short = (c != "") & (F.length(c) <= 60)
    return short & (c.rlike(r"^[A-Z0-9\s.,\-:;]{1,60}$") | ((F.length(c) <= 30) & c.rlike(r"\d{4}\s*$")))


def is_reference_line(c: Column) -> Column:
    return strip(c).rlike(r"^\d+\.\s+[A-Z][a-z]+\s+[A-Z]") | c.rlike(r"(?i)\bet\s+al\.?\b")


def is_artifact(c: Column) -> Column:
    return (strip(c) == "") | c.rlike(r"^\s*[IVX0-9\s.\-]+\s*$") | ((n_words(c) <= 2) & c.rlike(r"(?i)^[IVX]+[a-z]?\s+[A-C]?\s*$"))


def is_caption(c: Column) -> Column:
    """A caption near the start with little behind it, or a row of short cells between pipes."""
    at = r"(?i)\b(?:Table|Figure|Fig\.)\s+\d+"
    behind = F.element_at(F.split(c, at, 2), -1)
    named = c.rlike(at) & (F.regexp_instr(c, F.lit(at)) <= 150) & (n_words(behind) < 20)
    return named | (c.contains("|") & F.forall(F.split(c, r"\|"), lambda p: n_words(p) <= 4))


def caps_share(c: Column) -> Column:
    """Upper-case letters among letters; null without letters."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / n)


def is_noisy(c: Column) -> Column:
    """Four pipes or more, or a short line mostly in capitals."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (count_of(c, r"\|") >= 4) | ((n >= 10) & (F.coalesce(caps_share(c), F.lit(0.0)) > 0.75) & (n_words(c) <= 10))


def is_fragment(c: Column, leading: tuple = ("and", "or", "with", "for", "of", "in", "to", "by", "from"), trailing: tuple = ("and", "or", "with", "for", "of", "in", "the", "a", "an", "to", "is", "are", "was", "were", "by", "at", "on", "from")) -> Column:
    t = squeeze(filled(c))
    w = F.split(F.lower(t), " ")
    few = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 3
    return (F.length(strip(filled(c))) < 4) | few | F.element_at(w, -1).isin(*trailing) | F.element_at(w, 1).isin(*leading)


def is_fact(c: Column) -> Column:
    """Eight words or more, neither a list of abbreviations nor a reference."""
    note = r"(?:\b[A-Z0-9][\w\-–]{0,12}\s*[,=]\s*[a-zA-Z][^;]{2,80}; ){2,}"
    reference = r"(?i)\bet al\b|\b\d{4};\s*\d+|\bdoi\b|\bJ Am Coll\b|\bEur Heart J\b|\bJACC\b"
    return (n_words(c) >= 8) & ~F.concat(c, F.lit("; ")).rlike(note) & ~c.rlike(reference)


def merged_paragraphs(c: Column, sep: str = "\n\n") -> Column:
    """Paragraphs joined to the next while they end in a preposition or an incomplete verb."""
    open_end = r"(?i)\b(?:for|with|to|in|on|at|of|from|by|(?:should|must|may|can|will|would|could|shall) be)\s*$"
    parts = F.filter(F.transform(F.split(c, sep), strip), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), p)))
        return F.when((F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1)).rlike(open_end), F.lit(False)), grown).otherwise(F.concat(acc, F.array(p)))

    return F.when(F.size(parts) <= 1, c).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), sep))
