"""Inverted index and BM25 with squared rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.order import top_k

K1, B = 1.5, 0.75
#: What a request's word is called in the documents.
SYNONYMS = {"potassium": "hyperkalemia hyperkalaemia", "attack": "myocardial infarction", "pill": "diuretic", "pressure": "hypertension", "apnea": "apnoea"}


def postings(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, tf, len)"""
    t = docs.select(doc, tokens.alias("t")).select(doc, F.size("t").alias("len"), F.explode("t").alias("token"))
    return t.groupBy(doc, "token", "len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(token, df)"""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def expanded(words: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The words and, behind them, the synonyms of each."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.lit(v)))) if synonyms else None
    if table is None:
        return words
    more = F.transform(words, lambda w: T.search_words(T.filled(F.try_element_at(table, w))))
    return F.concat(words, F.flatten(more))


def bm25(docs: DataFrame, doc: str, tokens: Column, requests: DataFrame, request: str, words: Column, k: int, digits: int = 4) -> DataFrame:
    """(request, doc, score, rank): the k best documents of each request with a score over 0.

    Documents are cut down to the requests' words before anything is counted,
    so what is shuffled follows the requests' postings, not the corpus.
    """
    wanted = requests.select(request, F.explode(words).alias("token")).groupBy(request, "token").agg(F.count(F.lit(1)).alias("times"))
    terms = wanted.select("token").distinct()
    rows = docs.select(doc, tokens.alias("__t"))
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("__t")).alias("avg_len"))
    there = rows.select(doc, F.size("__t").alias("len"), F.explode("__t").alias("token")).join(terms, "token", "left_semi")
    there = there.groupBy(doc, "token", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = there.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = there.join(df, "token").join(wanted, "token").crossJoin(total)  # one row
    rarity = F.pow(F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 2)
    term = F.col("times") * rarity * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = scored.groupBy(request, doc).agg(F.round(F.sum(term), digits).alias("score")).where("score > 0")
    return top_k(scores, [request], [F.col("score").desc(), F.col(doc)], k)
