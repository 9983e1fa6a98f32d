"""Helpers shared by the operators: written lineage cuts, document keys, batched word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORDS = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 1 << 20


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder of spark.checkpoint.dir and read it back.

    The table replaces the lineage, so an executor lost later costs a reread and not a
    recomputation; the shuffle files of the write are dropped once it has committed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` of a few longs a row, to be broadcast if it has at most ``rows`` rows; beyond that the
    join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def local(df: DataFrame) -> pd.DataFrame:
    """A bounded result on the driver, over Arrow whatever the session's setting."""
    return df.toArrow().to_pandas()


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content: equal rows share it and get equal results."""
    return F.xxhash64(*[F.col(c) for c in cols])


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInPandas over slices of about CHUNK_BYTES of text, so that a worker's memory does not
    depend on how many rows Arrow puts into a batch. ``fn`` takes a pandas frame whose column
    ``text`` holds bytes and returns a frame or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = fn() if getattr(fn, "stateful", False) else fn
        for pdf in batches:
            raw = [b"" if t is None else bytes(t) for t in pdf["text"]]
            size = np.cumsum([len(t) for t in raw])
            part = size // CHUNK_BYTES
            pdf = pdf.assign(text=raw)
            for _, rows in pdf.groupby(part, sort=True):
                out = state(rows.reset_index(drop=True))
                if out is not None and len(out):
                    yield out
        end = getattr(state, "end", None)
        if end is not None:
            out = end()
            if out is not None and len(out):
                yield out

    return df.withColumn("text", F.col("text").cast("binary")).mapInPandas(run, schema)


# --- word hashes ---------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_pow = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _pow[base] = np.cumprod(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: bool = False):
    """64-bit hash of every word of ``texts`` and, for each text, where its words begin:
    (hashes, bounds with len(texts) + 1 entries). Words are runs of other bytes than space and
    9-13; ``fold`` lower-cases A-Z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    terms = (_FOLD if fold else _BYTE)[data] * _powers(_P, len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    h = mix((total[end] - total[start]) * _powers(_PI, len(data) + 1)[start])
    lens = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)]))
    return h, bounds


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (runs across texts included; mask them)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_P, len(h)))])
    return mix((total[k:] - total[:-k]) * _powers(_PI, len(h) + 1)[: len(h) - k + 1] + np.uint64(k))


# --- connected components ------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected links (a, b) of longs; component is the smallest node
    reachable. Alternating large-star / small-star rounds, each written to the shared folder:
    every round is a min per node (combined before the shuffle) and a join that Spark may split,
    so a hub with any number of links is never gathered. Nodes without links do not appear;
    null ends and self links are ignored; an empty input gives an empty result."""

    def stars(e: DataFrame, both: bool) -> DataFrame:
        side = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            side = side.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hit = side.join(least, "u")
        if both:  # larger neighbours hang on the least neighbour
            out = hit.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:     # smaller neighbours and the node itself hang on the least one
            out = hit.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                           F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = written(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"),
                                                F.least("a", "b").cast("long").alias("b"))
                  .distinct(), "cc")
    seen = mark(cur)
    while seen[0]:
        cur = written(stars(stars(cur, True), False), "cc")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
