r"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Texts are sequences of lines (cut at \n). A repeated passage is a run of
consecutive lines with `min_words` words or more that stands at two places.
Every line run of that kind is a union of shortest windows: for a line, the
shortest run with enough words that begins there, and the shortest that ends
there. So a suffix is compared to the depth of its window only.

Doubling: rank 0 orders the lines by their hash; rank k+1 orders the suffixes
by (rank k here, rank k of 2^k lines on), so it orders them by their first
2^(k+1) lines. Ranks are places in a range-partitioned sort of the distinct
pairs. A suffix whose prefix stands at one place only drops out, so the table
shrinks from round to round to what does repeat. A window of m lines, with
2^k <= m, is told by the ranks k of its first and last 2^k lines: windows with
the same pair share a longest-common-prefix interval of m lines or more.

Of each interval the first copy (by id, text hash and line) stays; the lines
of the later ones are deleted. Overlapping windows merge into the maximal
runs, which are reported. Blank lines belong to a run but have no words.

Only DataFrame functions are used. Minima and counts are partial aggregates,
the joins to them can be split by key, and windows see one document each.

Null text: no lines, nothing deleted, stays null. Empty text: one blank line.
Null id: an id of its own, before all others. Repeated rows (same id and text)
count as one document and get equal results; rows that share an id but not the
text are documents of their own. Empty table: empty result. Other columns are
kept by `dedup_lines`; the columns that it adds replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import drop, fresh, n_words, parted, table

MIN_WORDS = 50
_DOC = ("did", "th")


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.struct(F.col(id_col).isNotNull(), F.col(id_col)), F.xxhash64(text_col)


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """`by` and rank: an increasing number in the order of `by`, whose rows are distinct."""
    return table(keys.select(*by).orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines with a rank 0, shortest windows i..e whose every line stands at two places)."""
    did, th = _key(docs, id_col, text_col)
    split = docs.where(F.col(text_col).isNotNull()).select(did.alias("did"), th.alias("th"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    lines = split.select("did", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"), n_words(F.col("line")).alias("words"))
    lines = table(lines.repartition(*_DOC).dropDuplicates(["did", "th", "pos"]))
    counts = lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = _ranked(counts, ["h", "h2"])
    hashed, lines = lines, table(lines.join(ids, ["h", "h2"], "left").select(*_DOC, "pos", "words", "rank"))
    drop(hashed, ids)
    in_doc = Window.partitionBy(*_DOC)
    upto = in_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select("*", F.sum("words").over(upto).alias("w"), F.sum(F.col("rank").isNull().cast("long")).over(upto).alias("odd"))
    # A line starts at a number of words and ends at one. A start looks for the first end that is min_words on, an end for the last start that is as far back.
    marks = lines.select(*_DOC, "pos", "odd", "rank", F.explode(F.array(
        F.struct(F.lit(True).alias("start"), (F.col("w") - F.col("words") + min_words).alias("at")),
        F.struct(F.lit(False).alias("start"), F.col("w").alias("at")))).alias("m")).select(*_DOC, "pos", "odd", "rank", "m.*")
    this = F.struct("pos", (F.col("odd") - F.col("rank").isNull().cast("long")).alias("odd"))
    end_this = F.struct("pos", "odd")
    ahead = in_doc.orderBy(F.col("at").desc(), F.col("start").asc(), F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    back = in_doc.orderBy(F.col("at").asc(), F.col("start").desc(), F.col("pos").asc()).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select(
        *_DOC, "start", this.alias("i"), end_this.alias("e"),
        F.last(F.when(~F.col("start"), end_this), ignorenulls=True).over(ahead).alias("end"),
        F.last(F.when(F.col("start"), this), ignorenulls=True).over(back).alias("begin"))
    found = marks.select(*_DOC, F.when(F.col("start"), F.col("i")).otherwise(F.col("begin")).alias("i"), F.when(F.col("start"), F.col("end")).otherwise(F.col("e")).alias("e"))
    found = found.where((F.col("i.odd") == F.col("e.odd")) & (F.col("e.pos") >= F.col("i.pos")))
    found = found.select(*_DOC, F.col("i.pos").alias("i"), F.col("e.pos").alias("e")).distinct()
    return lines.where("rank is not null").select(*_DOC, "pos", "rank"), table(found)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, i, e): the windows of lines i..e that repeat an earlier window."""
    ranks, found = windows(docs, id_col, text_col, min_words)
    ranks, copies, k = table(ranks), None, 0
    while True:
        step = 1 << k
        size = F.col("e") - F.col("i") + 1
        due = found.where((size >= step) & (size < 2 * step))
        pairs = (
            due.join(ranks.withColumnRenamed("pos", "i").withColumnRenamed("rank", "head"), [*_DOC, "i"])
            .withColumn("pos", F.col("e") - (step - 1))
            .join(ranks.withColumnRenamed("rank", "tail"), [*_DOC, "pos"])
            .select(*_DOC, "i", "e", size.alias("m"), "head", "tail"))
        at = F.struct(*_DOC, "i")
        first = table(pairs.groupBy("m", "head", "tail").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        again = table(pairs.join(first, ["m", "head", "tail"]).where(at != F.col("first")).select(*_DOC, "i", "e"))
        copies = again if copies is None else copies.unionByName(again)
        drop(first)
        if found.where(size >= 2 * step).isEmpty():
            return copies
        ahead = Window.partitionBy(*_DOC).orderBy("pos")
        there = F.lead(F.struct("pos", "rank"), 1).over(ahead)
        near = ranks.select(*_DOC, "pos", "rank")
        if step > 1:
            on = ranks.select(*_DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
            near = near.join(on, [*_DOC, "pos"])
        else:
            near = near.select("*", there.alias("t")).where(F.col("t.pos") == F.col("pos") + 1).select(*_DOC, "pos", "rank", F.col("t.rank").alias("next"))
        near = table(near.withColumnRenamed("rank", "here"))
        keys = _ranked(near.groupBy("here", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["here", "next"])
        old, ranks = ranks, table(near.join(keys, ["here", "next"]).select(*_DOC, "pos", "rank"))
        drop(old, near, keys)
        k += 1


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, runs array<struct<i, e>>): the maximal line runs to delete of each document that has any."""
    copies = later_copies(docs, id_col, text_col, min_words)
    order = Window.partitionBy(*_DOC).orderBy("i", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("i") > before + 1, F.lit(True)).cast("long")
    runs = copies.select(*_DOC, "i", "e", new.alias("new"))
    runs = runs.select(*_DOC, "i", "e", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy(*_DOC, "run").agg(F.min("i").alias("i"), F.max("e").alias("e"))
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies deleted from the text, and with n_lines, n_removed and removed_runs."""
    runs = table(repeated_runs(docs, id_col, text_col, min_words))
    did, th = _key(docs, id_col, text_col)
    added = {text_col, "n_lines", "n_removed", "removed_runs"}
    untouched, touched = parted(docs, (did, th), runs, (F.col("did"), F.col("th")))
    none = F.array().cast("array<struct<i:int,e:int>>")
    my_id, my_th, r_id, r_th, r_runs, c, ln = fresh(docs, "__did", "__th", "__d", "__t", "__runs", "__cut", "__lines")
    d = touched.select("*", did.alias(my_id), th.alias(my_th))
    r = runs.select(F.col("did").alias(r_id), F.col("th").alias(r_th), F.col("runs").alias(r_runs))
    d = d.join(r, (F.col(my_id) == F.col(r_id)) & (F.col(my_th) == F.col(r_th)), "left")
    d = d.select(*docs.columns, F.coalesce(r_runs, none).alias(c)).unionByName(untouched.withColumn(c, none))
    d = d.select(*docs.columns, c, F.split(text_col, "\n", -1).alias(ln))
    cut, lines, n = F.col(c), F.col(ln), F.coalesce(F.size(ln), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x["e"] + 1))
    ends = F.concat(F.transform(cut, lambda x: x["i"]), F.array(n))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(F.size(cut) == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.aggregate(cut, F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["i"] + 1))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long")
    own = [text.alias(text_col) if x == text_col else F.col(x) for x in docs.columns if x == text_col or x not in added]
    return d.select(*own, n_lines.alias("n_lines"), gone.alias("n_removed"), cut.alias("removed_runs"))
