r"""Language ID by error-correcting output codes.

Each language has a codeword of bits; each bit is predicted by a binary
classifier over hashed byte n-grams, and decoding chooses the codeword whose
bits lose least. For up to seven languages the code is exhaustive (all two-way
splits, minimum distance 2^(L-2)); above that it is seeded and random, of
`bits` bits, with distinct columns.

Features: letters of the text (ASCII A-Z lower-cased, all other ASCII one
space), its byte 1- to 4-grams hashed to `DIM` cells, square roots of the
counts, unit length. Bits: logistic regression by gradient descent. Decoding:
logistic loss of each bit, weighted by the accuracy of its classifier in
training. `score` is the softmax of the negated losses at the chosen language;
a text is flagged ambiguous if the runner-up is within `MARGIN` of it.

Fitted on a bounded sample of labelled rows: about `sample` documents, alike
many of each language where there are so many, of texts up to `max_bytes`
(fitting only; prediction reads whole texts, piece by piece).

Null text, or no letter: `und`, score 0, ambiguous. Null labels are not learned
from. Null ids: fold of the empty text. Repeated rows get equal results. No
labelled row at all: every text is `und`. One language: always it. Empty
table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import fold

DIM, SAMPLE, MAX_BYTES, STEPS, BITS, MARGIN = 1 << 13, 2400, 16_000, 60, 63, 0.1
_PIECE = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed n-gram counts; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw, np.uint8)[at : at + _PIECE + 3].astype(np.uint32)
        gram = np.zeros(len(b), np.uint32)
        for n in range(4):  # n-grams that begin in this piece
            live = max(0, min(len(b) - n, _PIECE))
            gram = gram[:live] * np.uint32(257) + b[n : n + live] + np.uint32(1)
            counts += np.bincount((gram * _MULTIPLIERS[n]) >> np.uint32(32 - 13), minlength=DIM)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1 and 1, rows and columns distinct, no column constant."""
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1)) if n > 1 else np.zeros(1, np.int64)
        return np.where((splits[None, :] << 1 >> np.arange(n)[:, None]) & 1, 1.0, -1.0).astype(np.float32)
    rng = np.random.default_rng(seed)
    best, gap = None, -1.0
    for _ in range(20):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = np.where(rng.random(n) < 0.5, -1.0, 1.0).astype(np.float32)
            if abs(c.sum()) < n:
                columns.setdefault((c * c[0]).tobytes(), c)
        code = np.stack(list(columns.values()), axis=1)
        distance = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if distance > gap:
            best, gap = code, distance
    return best


class Model:
    def __init__(self, langs: list[str]):
        self.langs, self.code = langs, codewords(max(1, len(langs)))
        self.w = np.zeros((DIM, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        self.weight = np.ones(self.code.shape[1], np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 30.0, decay: float = 1e-4) -> Model:
        target = self.code[y]
        balance = (len(y) / np.bincount(y, minlength=len(self.langs)) / len(self.langs))[y].astype(np.float32)[:, None]
        vw, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):
            slope = -balance * target / (1 + np.exp(target * (x @ self.w + self.b))) / len(y)
            vw = 0.9 * vw - rate * 0.1 * (x.T @ slope + decay * self.w)
            vb = 0.9 * vb - rate * 0.1 * slope.sum(axis=0)
            self.w += vw
            self.b += vb
        right = ((x @ self.w + self.b) * target > 0).mean(axis=0)
        self.weight = np.clip(right - 0.5, 0.01, 0.5).astype(np.float32)
        return self

    def predict(self, texts: Iterator) -> list[tuple]:
        out = []
        for text in texts:
            x = features(text) if self.langs else None
            if x is None:
                out.append(("und", 0.0, True))
                continue
            bit = x @ self.w + self.b
            loss = (np.logaddexp(0, -self.code * bit) * self.weight).sum(axis=1) / self.weight.sum()
            order = np.argsort(loss, kind="stable")
            p = np.exp(loss[order[0]] - loss)
            margin = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
            out.append((self.langs[order[0]], float(1 / p.sum()), bool(margin < MARGIN)))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, max_bytes: int = MAX_BYTES) -> Model:
    """A model of a sample of the labelled rows of `docs`: rows by the hash of their id and text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= max_bytes))
    there = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}  # a row for each language
    if not there:
        return Model([])
    langs, each = sorted(there), sample / len(there)
    share = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))))
    draw = F.pmod(F.xxhash64(F.lit("lid"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / (1 << 30)
    got = rows.where(draw < share[F.col(lang_col)]).select(lang_col, text_col).collect()
    x, y = np.empty((len(got), DIM), np.float32), []
    for lang, text in sorted(got):
        v = features(text)
        if v is not None:
            x[len(y)] = v
            y.append(langs.index(lang))
    seen = sorted(set(y))
    if not seen:
        return Model([])
    return Model([langs[i] for i in seen]).fit(x[: len(y)], np.searchsorted(seen, y))


def predicted(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, ambiguous>."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(model.predict(texts), columns=["lang_pred", "score", "ambiguous"])

    return predict(text)


def held_out(id_col: Column) -> Column:
    return fold(id_col, 3) == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with held_out, lang_pred, score and ambiguous; learned from those not held out."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "ambiguous")]
    found = docs.select(*own, held_out(F.col(id_col)).alias("held_out"), predicted(F.col(text_col), model).alias("__found"))
    return found.select(*own, "held_out", "__found.*")
