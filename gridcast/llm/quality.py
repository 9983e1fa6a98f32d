"""Quality: gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded from what can be read off
its bytes and words (shares of character classes, word lengths, repetition inside the passage and
of earlier parts of the document). From document labels alone the model learns an encoder, a gated
attention weight for each passage, and a linear score of the attention-weighted sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import _SPACE, local, map_rows, window_hashes, word_hashes

PASSAGE = 64
FIT_ROWS = 16_000   # labelled documents the model is fitted on, the first by hash of doc_id
HIDDEN = 24
GATE = 12
EPOCHS = 30
BATCH = 256

_MARKS = b".,!?|*#$%&:;\"'()<>/\\@=+-_[]{}^~`"
_CLASS = np.zeros(256, np.int64)                       # 0: other control bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[32], _CLASS[10] = 5, 6
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 7 + min(_i, 15)
CLASSES = 7 + 16
WIDTH = CLASSES + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, features) of every passage; a text without words has one blank passage."""
    h, bounds = word_hashes(texts)
    n = np.diff(bounds)
    count = np.maximum(-(-n // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(count)])
    total = int(base[-1])
    bag = np.repeat(np.arange(len(texts)), count)
    word_doc = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(len(h)) - bounds[word_doc]
    of = base[word_doc] + inside // PASSAGE
    x = np.zeros((total, WIDTH), np.float32)

    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    word_at = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    owner = np.searchsorted(word_at, np.arange(len(data)), side="right") - 1  # word that a byte follows
    real = (owner >= 0)
    real[np.cumsum([len(t) + 1 for t in texts]) - 1] = False                  # the joining line ends
    if len(h):
        at = of[owner[real]]
        x[:, :CLASSES] = np.bincount(at * CLASSES + _CLASS[data[real]], minlength=total * CLASSES).reshape(total, CLASSES)
        size = np.maximum(x[:, :CLASSES].sum(1, keepdims=True), 1)
        words = np.bincount(of, minlength=total)
        some = np.maximum(words, 1)
        letters = np.bincount(of, minlength=total, weights=np.diff(np.append(word_at, len(data))))
        x[:, CLASSES] = letters / some / 10
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        x[:, CLASSES + 1] = np.bincount(of, weights=again, minlength=total) / some
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        x[:, CLASSES + 2] = np.bincount(of[order], weights=new, minlength=total) / some
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        most = np.zeros(total)
        np.maximum.at(most, of[order][new], run)
        x[:, CLASSES + 3] = most / some
        if len(h) >= 4:  # words that begin a four-word run seen earlier in the document
            w = window_hashes(h, 4)
            ok = inside[: len(w)] + 4 <= n[word_doc[: len(w)]]
            d, w, o = word_doc[: len(w)][ok], w[ok], of[: len(w)][ok]
            by = np.lexsort((np.arange(len(w)), w, d))
            seen = np.zeros(len(w), bool)
            seen[1:] = (d[by][1:] == d[by][:-1]) & (w[by][1:] == w[by][:-1])
            x[:, CLASSES + 4] = np.bincount(o[by], weights=seen, minlength=total) / some
        x[:, CLASSES + 5] = np.log1p(words) / 5
        x[:, :CLASSES] /= size
        caps = np.zeros(len(h))
        first = data[word_at]
        second = data[np.minimum(word_at + 1, len(data) - 1)]
        caps[(first >= 65) & (first <= 90) & (second >= 65) & (second <= 90)] = 1
        x[:, CLASSES + 6] = np.bincount(of, weights=caps, minlength=total) / some
    x[:, CLASSES + 7] = (np.log1p(n) / 10)[bag]
    return bag, x


class Model:
    """Weights of the encoder (W), the gates (V, U, a) and the score (c), with the scaling."""

    def __init__(self, mean, scale, par):
        self.mean, self.scale, self.par = mean, scale, par

    def forward(self, bag: np.ndarray, x: np.ndarray, bags: int):
        """Score of each bag; the passages are in the order of their bags."""
        p = self.par
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["w0"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["a"]
        start = np.searchsorted(bag, np.arange(bags))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        att = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(att[:, None] * h, start, axis=0)
        return x, h, t, s, att, z, 1 / (1 + np.exp(-(z @ p["c"] + p["c0"])))


def _train(bag: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Adam over mini-batches of whole bags; a fixed seed, so refits agree."""
    rng = np.random.default_rng(11)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    m = Model(mean, scale, {
        "W": rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), "w0": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
        "a": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
        "c0": np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))})
    one = {k: np.zeros_like(v, dtype=float) for k, v in m.par.items()}
    two = {k: np.zeros_like(v, dtype=float) for k, v in m.par.items()}
    first = np.searchsorted(bag, np.arange(len(y) + 1))
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i:i + BATCH]
            rows = np.concatenate([np.arange(first[j], first[j + 1]) for j in pick])
            own = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
            xs, h, t, s, att, z, out = m.forward(own, x[rows], len(pick))
            p = m.par
            dz = (out - y[pick])[:, None] / len(pick)
            g = {"c": (dz * z).sum(0), "c0": dz.sum()}
            dbag = dz * p["c"]
            dh = att[:, None] * dbag[own]
            datt = (dbag[own] * h).sum(1)
            start = np.searchsorted(own, np.arange(len(pick)))
            de = att * (datt - np.add.reduceat(att * datt, start)[own])
            g["a"] = (t * s).T @ de
            dts = de[:, None] * p["a"]
            dt, du = dts * s * (1 - t * t), dts * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ du
            dh += dt @ p["V"].T + du @ p["U"].T
            dpre = dh * (1 - h * h)
            g["W"], g["w0"] = xs.T @ dpre, dpre.sum(0)
            step += 1
            for k, v in g.items():
                v = v + (1e-4 * p[k] if k not in ("c0", "w0") else 0)
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                p[k] = p[k] - rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(sample: DataFrame) -> Model:
    """Model from (text, y in 0/1). Passages are encoded by the tasks; the features of the bounded
    sample reach the driver, no text does. Without rows of both classes the score is constant
    (0.5 without rows)."""
    def encode(rows: pd.DataFrame):
        bag, x = passages(list(rows["text"]))
        cut = np.searchsorted(bag, np.arange(len(rows) + 1))
        return pd.DataFrame({"y": rows["y"], "x": [x[a:b].ravel() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    data = local(map_rows(sample.select("text", "y"), encode, "y int, x array<float>"))
    y = (data["y"].to_numpy() == 1).astype(float)
    if not len(y) or y.min() == y.max():
        bias = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        zero = {"W": np.zeros((WIDTH, HIDDEN)), "w0": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)),
                "U": np.zeros((HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "c0": np.array(bias)}
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero)
    x = [np.asarray(v, np.float32).reshape(-1, WIDTH) for v in data["x"]]
    return _train(np.repeat(np.arange(len(y)), [len(v) for v in x]), np.concatenate(x), y)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of good quality, 0 to 1, from all passages of the
    text. Null and empty texts are one blank passage; repeated rows are scored each; extra columns
    pass through (one named ``out`` is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(**held.value)
        for texts in batches:
            raw = [b"" if t is None else bytes(t) for t in texts]
            part = np.cumsum([len(t) for t in raw]) >> 20
            got = []
            for p in np.unique(part):
                some = [raw[i] for i in np.flatnonzero(part == p)]
                bag, x = passages(some)
                got.append(model.forward(bag, x, len(some))[-1])
            yield pd.Series(np.concatenate(got) if got else np.empty(0))

    return docs.withColumn(out, run(F.col(text).cast("binary")))
