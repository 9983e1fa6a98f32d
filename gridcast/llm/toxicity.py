"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is its UTF-8 bytes with A-Z lower-cased and white space as a blank; its features are the
distinct runs of 4, 5 and 6 bytes. On a bounded sample of labelled texts, each feature gets its
log-count ratio r (smoothed, by class); the features with the strongest evidence are kept, and a
logistic regression is fitted on r where the feature occurs. Scores read whole texts: a bit table
drops almost all positions, the rest are looked up exactly by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import _powers, local, map_rows, mix

GRAMS = (4, 5, 6)
FIT_ROWS = 16_000        # labelled rows the classifier is fitted on, the first by hash of doc_id
FEATURES = 4096
MIN_TEXTS = 4            # texts a feature must occur in
SMOOTH = 0.5
RIDGE = 1.0
BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_CODE = np.random.default_rng(4057).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, rows: int) -> DataFrame:
    """(text, y): at most ``rows`` labelled documents outside the held-out fold, the first by hash
    of doc_id. Labels of one doc_id are reduced to the greatest; null labels do not count; a
    doc_id with several documents gives each of them."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .filter(~held_out(F.col("doc_id"), modulus, rest))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("text", "y")


def _grams(texts: list[bytes]):
    """Hash of each n-gram that lies inside one text, with its text: (text index, hash) by size."""
    data = _LOWER[np.frombuffer(b"\x00".join(texts), np.uint8)]
    lens = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    doc = np.repeat(np.arange(len(texts)), lens + 1)[: len(data)]
    left = np.repeat(start + lens, lens + 1)[: len(data)] - np.arange(len(data))  # bytes to the end
    code, p = _CODE[data], _powers(np.uint64(0x9E3779B97F4A7C15), 8)
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] + code[n - 1:] * p[n - 1]
        if n in GRAMS:
            yield doc[: len(h)], h + np.uint64(n), left[: len(h)] >= n


def _occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    docs, grams = [], []
    for doc, h, inside in _grams(texts):
        docs.append(doc[inside])
        grams.append(mix(h[inside]).view(np.int64))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc, g = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[new], g[new]


class Model:
    """Sorted feature hashes, their weights (w * r) and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        table = np.zeros(1 << BITS, bool)
        table[(self.features.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)] = True

        def score(texts: list[bytes]) -> np.ndarray:
            docs, hits = [], []
            for doc, h, inside in _grams(texts):
                g = mix(h)
                maybe = np.flatnonzero(table[(g >> np.uint64(64 - BITS)).view(np.int64)] & inside)
                if len(maybe) and len(self.features):
                    want = g[maybe].view(np.int64)
                    at = np.searchsorted(self.features, want).clip(0, len(self.features) - 1)
                    ok = self.features[at] == want
                    docs.append(doc[maybe][ok])
                    hits.append(at[ok])
            z = np.full(len(texts), self.bias)
            if docs:
                seen = np.unique(np.concatenate(docs) * len(self.features) + np.concatenate(hits))
                z += np.bincount(seen // len(self.features), self.weights[seen % len(self.features)],
                                 minlength=len(texts))
            return 1 / (1 + np.exp(-z.clip(-500, 500)))

        return score


def _logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n: int, ridge: float,
              steps: int = 200) -> tuple[np.ndarray, float]:
    """L2 logistic regression on a sparse matrix by accelerated gradient steps. The step is the
    inverse of a bound on the curvature, from the largest column and row sums."""
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rowsum = np.bincount(rows, np.abs(vals), minlength=len(y)).max(initial=1.0)
    colsum = np.bincount(cols, np.abs(vals), minlength=n).max(initial=1.0)
    size = 0.25 * (rowsum * colsum + len(y)) + ridge
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, vals * v[cols], minlength=len(y)) + vb
        g = 1 / (1 + np.exp(-z.clip(-500, 500))) - y
        w2 = v - (np.bincount(cols, vals * g[rows], minlength=n) + ridge * v) / size
        b2 = vb - g.sum() / size
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(sample: DataFrame, features: int = FEATURES) -> Model:
    """Classifier from (text, y in 0/1). The counts are a distributed aggregate; only ``features``
    hashes and the sample's hits on them reach the driver. Without rows the score is 0.5
    everywhere, with one class that class's share."""
    sample = sample.select("text", "y")
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        bias = 0.0 if pos == neg else float(np.log((pos + SMOOTH) / (neg + SMOOTH)))
        return Model(np.empty(0, np.int64), np.empty(0), bias)

    def count(rows: pd.DataFrame):
        doc, g = _occurrences(list(rows["text"]))
        y = rows["y"].to_numpy()[doc]
        u, at = np.unique(g, return_inverse=True)
        return pd.DataFrame({"g": u, "p": np.bincount(at[y == 1], minlength=len(u)),
                             "n": np.bincount(at[y != 1], minlength=len(u))})

    counts = (map_rows(sample, count, "g long, p long, n long").groupBy("g")
              .agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter(F.col("p") + F.col("n") >= MIN_TEXTS))
    ratio = F.log((F.col("p") + SMOOTH) / (pos + 2 * SMOOTH)) - F.log((F.col("n") + SMOOTH) / (neg + 2 * SMOOTH))
    evidence = F.abs(ratio) * F.sqrt(F.when(ratio > 0, F.col("p") / pos).otherwise(F.col("n") / neg))
    best = local(counts.select("g", ratio.alias("r"), evidence.alias("e")).orderBy(F.desc("e"), "g").limit(features))
    best = best.sort_values("g")
    feats, r = best["g"].to_numpy(np.int64), best["r"].to_numpy(float)

    def hits(rows: pd.DataFrame):
        doc, g = _occurrences(list(rows["text"]))
        at = np.searchsorted(feats, g).clip(0, len(feats) - 1)
        ok = feats[at] == g
        cut = np.searchsorted(doc[ok], np.arange(1, len(rows)))
        return pd.DataFrame({"y": rows["y"], "at": np.split(at[ok].astype(np.int32), cut)})

    if not len(feats):
        return Model(feats, r, float(np.log(pos / neg)))
    data = local(map_rows(sample, hits, "y int, at array<int>"))
    lens = np.array([len(a) for a in data["at"]])
    cols = np.concatenate(data["at"].to_list()).astype(np.int64) if lens.sum() else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(data)), lens)
    y = (data["y"].to_numpy() == 1).astype(float)
    w, b = _logistic(rows, cols, r[cols], y, len(feats), RIDGE)
    return Model(feats, w * r, b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability that a text is toxic, 0 to 1, from the whole text
    alone. Null and empty texts get the score of a text without features; repeated rows are scored
    each; extra columns pass through (one named ``out`` is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Model(**held.value).scorer()
        for texts in batches:
            raw = [b"" if t is None else bytes(t) for t in texts]
            part = np.cumsum([len(t) for t in raw]) >> 20
            got = [scorer([raw[i] for i in np.flatnonzero(part == p)]) for p in np.unique(part)]
            yield pd.Series(np.concatenate(got) if got else np.empty(0))

    return docs.withColumn(out, run(F.col(text).cast("binary")))
