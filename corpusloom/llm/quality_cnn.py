r"""Quality classifier: a byte-level convolutional network in numpy.

A learned embedding of the bytes goes through filters of width 8 and stride 4
(rectified); each filter is max-pooled over chunks of 512 bytes that overlap by
half and cover the whole text. The chunks' pooled features, their mean and
their maximum over the text, are combined by a logistic unit into the
probability of label 1.

Training: Adam over a sample of labelled rows, by the hash of their ids, of
`sample` rows at most and texts of up to `max_bytes`; drawing ids first keeps
the join to their texts a broadcast of `sample` ids. Scoring reads whole
texts, in segments.

Null text counts as empty, which is scored like any other (one padded chunk).
Null labels are not learned from; of repeated labels of an id the larger
counts. If the sample lacks one of the labels the score is the share of 1
(no rows: 0.5). Null ids are never learned from. Empty table: empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import fold

SAMPLE, MAX_BYTES, EPOCHS, THRESHOLD = 4000, 16_000, 6, 0.3
EMBED, FILTERS, STRIDE, HALF = 8, 24, 4, 256
_ROWS = HALF // STRIDE
_SEGMENT = 1 << 10  # half chunks at a time


def padded(text: str | None) -> np.ndarray:
    """The bytes of a text and zeros up to whole half chunks."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return np.concatenate((raw, np.zeros(HALF - len(raw) % HALF, np.uint8)))


class ByteNet:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": f32(256, EMBED, scale=0.5), "w0": f32(STRIDE * EMBED, FILTERS, scale=0.2), "w1": f32(STRIDE * EMBED, FILTERS, scale=0.2),
            "bias": np.zeros(FILTERS, np.float32), "mean": f32(FILTERS, scale=0.3), "max": f32(FILTERS, scale=0.3), "out": np.zeros(1, np.float32),
        }
        self.prior: float | None = None

    def halves(self, raw: np.ndarray) -> np.ndarray:
        """Max-pooled features of each half chunk; a filter at its end looks STRIDE bytes on."""
        out = np.empty((len(raw) // HALF, FILTERS), np.float32)
        tail = np.concatenate((raw, np.zeros(STRIDE, np.uint8)))
        for at in range(0, len(out), _SEGMENT):
            end = min(at + _SEGMENT, len(out))
            x = self.p["embed"][tail[at * HALF : end * HALF + STRIDE]].reshape(-1, STRIDE * EMBED)
            a = x[:-1] @ self.p["w0"] + x[1:] @ self.p["w1"]
            out[at:end] = a.reshape(-1, _ROWS, FILTERS).max(axis=1)
        return np.maximum(out + self.p["bias"], 0)

    def pooled(self, raws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum over the chunks of each text. Texts stand one after another, each with half a chunk of zeros behind."""
        sizes = np.array([len(r) // HALF for r in raws])
        h = self.halves(np.concatenate([x for r in raws for x in (r, np.zeros(HALF, np.uint8))]))
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        chunk = np.maximum(h[:-1], h[1:])  # two neighbouring halves
        n = np.maximum(sizes - 1, 1)
        spans = np.column_stack((begins, begins + n)).ravel()
        chunk = np.vstack((chunk, np.zeros((1, FILTERS), np.float32)))
        return np.add.reduceat(chunk, spans)[::2] / n[:, None], np.maximum.reduceat(chunk, spans)[::2]

    def scores(self, texts: list) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out, group, size = [], [], 0
        for text in texts:
            group.append(padded(text))
            size += len(group[-1])
            if size >= _SEGMENT * HALF:
                out.append(self.pooled(group))
                group, size = [], 0
        if group:
            out.append(self.pooled(group))
        z = np.concatenate([m @ self.p["mean"] + x @ self.p["max"] for m, x in out]) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + float(self.p["out"][0]), -30, 30)))

    def gradient(self, raws: list[np.ndarray], y: np.ndarray) -> dict:
        p, n = self.p, len(raws)
        sizes = np.array([len(r) // HALF for r in raws])
        stream = np.concatenate([x for r in raws for x in (r, np.zeros(HALF, np.uint8))] + [np.zeros(STRIDE, np.uint8)])
        x = p["embed"][stream].reshape(-1, STRIDE * EMBED)
        a = (x[:-1] @ p["w0"] + x[1:] @ p["w1"] + p["bias"]).reshape(-1, _ROWS, FILTERS)
        arg = a.argmax(axis=1)
        top = np.take_along_axis(a, arg[:, None, :], axis=1)[:, 0]
        h = np.maximum(top, 0)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        count = np.maximum(sizes - 1, 1)
        left = np.concatenate([np.arange(b, b + c) for b, c in zip(begins, count, strict=True)])
        owner = np.repeat(np.arange(n), count)
        chunk = np.maximum(h[left], h[left + 1])
        starts = np.concatenate(([0], np.cumsum(count)[:-1]))
        mean, peak = np.add.reduceat(chunk, starts) / count[:, None], np.maximum.reduceat(chunk, starts)
        z = mean @ p["mean"] + peak @ p["max"] + p["out"]
        dz = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        g = {"mean": dz @ mean, "max": dz @ peak, "out": dz.sum(keepdims=True)}
        is_peak = chunk == peak[owner]
        ties = np.add.reduceat(is_peak.astype(np.float32), starts)
        dchunk = (dz / count)[owner][:, None] * p["mean"] + is_peak / ties[owner] * dz[owner][:, None] * p["max"]
        dh = np.zeros_like(h)
        right = h[left + 1] > h[left]
        np.add.at(dh, left, np.where(right, 0, dchunk))
        np.add.at(dh, left + 1, np.where(right, dchunk, 0))
        dh *= top > 0
        g["bias"] = dh.sum(axis=0)
        block, f = np.nonzero(dh)
        row, d = block * _ROWS + arg[block, f], dh[block, f]
        x0, x1 = x[row], x[row + 1]
        g["w0"], g["w1"] = np.zeros_like(p["w0"]), np.zeros_like(p["w1"])
        g["embed"] = np.zeros_like(p["embed"])
        codes = stream.reshape(-1, STRIDE)
        for k in range(FILTERS):
            at = f == k
            g["w0"][:, k], g["w1"][:, k] = d[at] @ x0[at], d[at] @ x1[at]
        for rows, w in ((row, p["w0"]), (row + 1, p["w1"])):
            back = (d[:, None] * w.T[f]).reshape(-1, EMBED)
            flat = codes[rows].ravel()
            for e in range(EMBED):
                g["embed"][:, e] += np.bincount(flat, back[:, e], minlength=256).astype(np.float32)
        return g

    def fit(self, texts: list, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 2) -> ByteNet:
        labels = np.asarray(labels, np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.prior = float(labels.mean()) if len(labels) else 0.5
            return self
        raws, rng = [padded(t) for t in texts], np.random.default_rng(seed)
        self.p["out"][0] = np.log(labels.mean() / (1 - labels.mean()))
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = min(60, max(epochs, 750 // max(1, len(raws) // batch)))  # a small sample takes more rounds
        for epoch in range(steps):
            order = rng.permutation(len(raws))
            for i in range(0, len(order), batch):
                pick, t = order[i : i + batch], t + 1
                for k, g in self.gradient([raws[j] for j in pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - epoch / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self


def held_out(id_col: Column) -> Column:
    return fold(id_col, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, max_bytes: int = MAX_BYTES) -> ByteNet:
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    ids = ids.orderBy(F.xxhash64(F.lit("quality"), "__id"), "__id").limit(sample)
    rows = docs.where(F.octet_length(text_col) <= max_bytes).join(F.broadcast(ids), F.col(id_col) == F.col("__id"))
    got = sorted(tuple(r) for r in rows.select("__id", text_col, "__label").dropDuplicates(["__id"]).collect())
    return ByteNet().fit([r[1] for r in got], np.array([r[2] for r in got]))


def scored(text: Column, net: ByteNet) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.scores(list(texts)), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    net = fit(docs, labels, id_col, text_col, label_col)
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scored(F.col(text_col), net).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
