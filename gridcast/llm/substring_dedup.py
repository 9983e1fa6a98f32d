"""Substring dedup: repeated windows of ``width`` words by hashed prefixes of two lengths.

This stands in for a suffix tree partitioned by variable prefixes: no suffix is sorted, no tree is
built and no group is sized to memory (see the README). A document is a string of words:

1. Prefixes of ``seed`` words. One place per ``width``-window is enough: the one whose seed has the
   least hash in the window (equal windows choose the same one). The windows that chose a seed that
   occurs once cannot repeat.
2. The other windows are counted by the 64-bit hash of their ``width`` words; those that occur twice
   or more are the repeats. Neighbouring windows of a longer repeat overlap, and their union is that
   repeat. Words are not compared again, so two windows of one hash count as equal.

Counts are combined before each shuffle and the rows come back by joins that Spark may split, so
a prefix that a third of all windows share costs one row per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_rows, row_key, window_hashes, word_hashes, written

WIDTH = 35
SEED = 8


def _chosen(texts: list[bytes], width: int, seed: int):
    """Of each whole window: its text, first word (from the text's first), place and seed prefix
    hash of the chosen suffix, and full hash."""
    h, bounds = word_hashes(texts)
    n = np.diff(bounds)
    windows = np.maximum(n - width + 1, 0)
    empty = np.empty(0, np.int64)
    if not windows.sum():
        return empty, empty, empty, empty, empty
    g = window_hashes(h, seed)
    span = width - seed + 1
    doc = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = bounds[doc] + first
    pick = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1)[at] + at
    return doc, first, pick, g[pick].view(np.int64), window_hashes(h, width)[at].view(np.int64)


def repeated_windows(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(key, starts): for each document content with repeats, the first words (from 0) of its
    windows of ``width`` words whose sequence also starts anywhere else, itself included.

    ``docs``: key, text. Rows with equal keys are copies: each counts as a place. Texts with
    fewer than ``width`` words, empty and null texts have no window. ``seed`` <= ``width``.
    """
    def seeds(rows: pd.DataFrame):
        doc, _, pick, g, _ = _chosen(list(rows["text"]), width, seed)
        if not len(doc):
            return None
        # neighbouring windows choose the same suffix: one row for each (document, prefix), with
        # the number of separate suffixes
        change = np.concatenate([[True], pick[1:] != pick[:-1]])
        out = pd.DataFrame({"g": g[change], "doc": doc[change]})
        out = out.groupby(["doc", "g"], sort=False).size().rename("c").reset_index()
        return pd.DataFrame({"key": rows["key"].to_numpy()[out["doc"]], "g": out["g"],
                             "c": out["c"]})

    level = written(map_rows(docs.select("key", "text"), seeds, "key long, g long, c int"), "seed")
    inner = level.groupBy("g").agg(F.sum("c").alias("c")).filter("c > 1").select("g")
    alive = written(level.join(inner, "g").groupBy("key").agg(F.collect_set("g").alias("alive")),
                    "alive")

    def deep(rows: pd.DataFrame):
        doc, first, _, g, w = _chosen(list(rows["text"]), width, seed)
        if not len(doc):
            return None
        keep = np.zeros(len(doc), bool)
        cut = np.searchsorted(doc, np.arange(len(rows) + 1))
        for i, live in enumerate(rows["alive"]):
            a, b = cut[i], cut[i + 1]
            keep[a:b] = np.isin(g[a:b], np.asarray(live, np.int64))
        return pd.DataFrame({"key": rows["key"].to_numpy()[doc[keep]], "start": first[keep],
                             "w": w[keep]})

    suffixes = written(map_rows(docs.select("key", "text").join(alive, "key"), deep,
                                "key long, start int, w long"), "suffix")
    nodes = suffixes.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    return written(suffixes.join(nodes, "w").groupBy("key")
                   .agg(F.collect_set("start").alias("starts")), "repeats")


def _cover(n: int, starts, width: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    s = np.asarray(starts, np.int64)
    np.add.at(step, s, 1)
    np.add.at(step, s + width, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, text: str = "text",
                   digest: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with every word removed that a repeated window of ``width`` words covers.

    Adds n_words, n_removed, and replaces the text: a text without repeats stays as it is (null
    included), else each removed word goes with the white space behind it. With ``digest`` the
    result is ``keys``, n_words, n_removed, kept_sha256 (kept words joined by one space). Words
    are runs of characters other than space and 9-13, unchanged; null and empty texts have none.
    Windows are judged on the input. Equal rows are separate documents and so repeat each other.
    Extra columns pass through; columns named like the added ones are replaced.
    """
    tmp = "__text"
    base = docs.withColumn("__key", row_key(*keys, text))
    marks = repeated_windows(base.select(F.col("__key").alias("key"), F.col(text).alias("text")),
                             width, seed).withColumnRenamed("key", "__key")

    if digest:
        def cut(rows: pd.DataFrame):
            out = []
            for raw, starts in zip(rows["text"], rows["__starts"], strict=True):
                words = raw.split()
                n, gone = len(words), 0
                if starts is not None:
                    dead = _cover(n, starts, width)
                    gone = int(dead.sum())
                    words = [w for w, d in zip(words, dead.tolist(), strict=True) if not d]
                out.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            return rows[list(keys)].assign(n_words=[x[0] for x in out],
                                           n_removed=[x[1] for x in out],
                                           kept_sha256=[x[2] for x in out])

        hit = base.select("__key", *keys, F.col(text).alias("text")).join(
            marks.withColumnRenamed("starts", "__starts"), "__key", "left")
        types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
        return map_rows(hit.drop("__key"), cut,
                        f"{types}, n_words long, n_removed long, kept_sha256 string")

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut_text(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, starts, strict=True):
            raw = b"" if t is None else t.encode()
            words = raw.split()
            if s is None:
                out.append((t, len(words), 0))
                continue
            dead = _cover(len(words), s, width)
            kept, at = [], 0
            for w, d in zip(words, dead.tolist(), strict=True):
                begin = raw.index(w, at)
                if not kept and begin > at and at == 0:
                    kept.append(raw[:begin])
                at = begin + len(w)
                end = at
                while end < len(raw) and raw[end] in b" \t\n\x0b\x0c\r":
                    end += 1
                if not d:
                    kept.append(raw[begin:end])
                at = end
            out.append((b"".join(kept).decode(), len(words), int(dead.sum())))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    hit = base.join(marks.withColumnRenamed("starts", "__starts"), "__key", "left").withColumn(
        tmp, cut_text(F.col(text), F.col("__starts")))
    return hit.select(*[F.col(f"{tmp}.text").alias(c) if c == text else F.col(f"`{c}`")
                        for c in names],
                      F.col(f"{tmp}.n_words").alias("n_words"),
                      F.col(f"{tmp}.n_removed").alias("n_removed"))
