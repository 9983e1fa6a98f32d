"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

Vectors become integers floor(scale * x) and are taken, like the centroids, through the exact
integer Walsh-Hadamard transform, whose coefficients stand in order of sequency. The transform
multiplies every squared distance by the dimension, and a sum over the first coefficients is a lower
bound of the whole. So each vector finishes the centroid that is nearest by the coarsest
coefficients, and the others gather coefficient differences from coarse to fine until they exceed
that distance: only strictly worse centroids go. Those left are compared over all coefficients, ties
to the smaller number. Nothing is rounded.

A round is one pass: tasks add up components, rows and distances per centroid, Spark adds the tasks'
partial sums (split into 32-bit digits, so that sums of any size are exact), and at most
centroids x (dimension + 2) sums reach the driver. No vector is shuffled.

Kept are vectors of exactly ``dim`` components, none null or non-finite; others have no row in the
result. A null id counts as empty text in the hash that picks the first centroids; equal hashes go
by the vector. Components beyond 2**21 after scaling are carried as whole numbers of any size; a
distance or an inertia that a long can't hold is null. Fewer rows than centroids give as many
centroids as rows, an empty table an empty result; repeated rows count each.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import local, written

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
STEPS = (4, 12, 28)     # coefficients seen when centroids are dropped; then all
SAFE = 1 << 21          # below, sums of squared coefficient differences fit 64 bits at dim 64
SLICE = 8192
LONG = 1 << 63


def sequency(dim: int) -> np.ndarray:
    """Rows of the Hadamard matrix (natural order) by number of sign changes."""
    i = np.arange(dim)
    ones = (i[:, None] & i[None, :])[..., None] >> np.arange(max(dim.bit_length(), 1)) & 1
    sign = ones.sum(-1) & 1
    return np.argsort((sign[:, 1:] != sign[:, :-1]).sum(1), kind="stable")


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Integer transform of each row, coefficients coarse to fine."""
    n, dim = rows.shape
    step = 1
    while step < dim:
        half = rows.reshape(n, dim // (2 * step), 2, step)
        a, b = half[:, :, 0], half[:, :, 1]
        rows = np.stack([a + b, a - b], axis=2).reshape(n, dim)
        step *= 2
    return rows[:, sequency(dim)]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, beyond ``SAFE``, as Python's."""
    values = np.asarray(values, np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() <= SAFE:
        return scaled.astype(np.int64)
    whole = [int(s) if np.isfinite(s) else int(v) * scale for v, s in zip(values.ravel(), scaled.ravel(), strict=True)]
    return np.array(whole, object).reshape(values.shape)


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each transformed vector ``x`` among the transformed ``c``."""
    n, dim = x.shape
    steps = [s for s in STEPS if s < dim] + [dim]
    seen = squares(x[:, None, :steps[0]] - c[None, :, :steps[0]])
    guess = np.argmin(seen, axis=1)
    best = squares(x - c[guess])                       # finished: an upper bound
    row, col = np.nonzero(seen <= best[:, None])
    part = seen[row, col]
    for lo, hi in zip(steps, steps[1:], strict=False):
        part = part + squares(x[row, lo:hi] - c[col, lo:hi])
        stay = (part <= best[row]).astype(bool)
        row, col, part = row[stay], col[stay], part[stay]
    least = np.full(n, None, object) if part.dtype == object else np.full(n, np.iinfo(np.int64).max)
    if part.dtype == object:
        for r, p in zip(row, part, strict=True):
            least[r] = p if least[r] is None else min(least[r], p)
    else:
        np.minimum.at(least, row, part)
    hit = (part == least[row]).astype(bool)
    row, col = row[hit], col[hit]
    first = np.unique(row, return_index=True)[1]       # columns ascend within a row
    return col[first].astype(np.int32), least // dim


def assign_rows(ints: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    big = ints.dtype == object or any(abs(v) > SAFE for c in centroids for v in c)
    kind = object if big else np.int64
    return nearest(hadamard(ints.astype(kind)), hadamard(np.array(centroids, kind)))


def kept_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` components, none null or non-finite."""
    if df.schema[vector].dataType not in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False)):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size(vector) == dim) & ~bad)


def _slices(batches: Iterator[pa.RecordBatch], vector: str, dim: int):
    """(rows, their components) in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            yield rows, rows.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _typed(values: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integers): rows of large components apart, so that one does not slow the others."""
    large = np.abs(values.astype(np.float64)).max(axis=1, initial=0) * scale > SAFE
    for at in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(at):
            yield at, integers(values[at], scale)


def _digits(v: int) -> Iterator[tuple[int, int]]:
    sign, v, at = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield at, sign * (v & 0xFFFFFFFF)
        v, at = v >> 32, at + 1


def totals(vectors: DataFrame, vector: str, centroids: list[list[int]], dim: int, scale: int) -> dict:
    """{centroid: [sum of each component..., rows, sum of distances]} over the nearest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for _, values in _slices(batches, vector, dim):
            for _, ints in _typed(values, scale):
                cluster, distance = assign_rows(ints, centroids)
                for c in np.unique(cluster):
                    mine = cluster == c
                    new = [*ints[mine].sum(axis=0), mine.sum(), sum(distance[mine].tolist())]
                    old = held.get(int(c), [0] * (dim + 2))
                    held[int(c)] = [a + int(b) for a, b in zip(old, new, strict=True)]
        rows = [(c, f, d, v) for c, fields in held.items() for f, x in enumerate(fields) for d, v in _digits(x)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "f", "d", "v"])

    sums = vectors.select(vector).mapInArrow(run, "c int, f int, d int, v long")
    out: dict[int, list[int]] = {}
    for r in local(sums.groupBy("c", "f", "d").agg(F.sum("v").alias("v"))).itertuples():
        out.setdefault(int(r.c), [0] * (dim + 2))[int(r.f)] += int(r.v) << (32 * int(r.d))
    return out


def first_centroids(vectors: DataFrame, key: str, vector: str, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors of least sha256 of ``seed:key``, as integers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    top = vectors.select(F.sha2(name, 256).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in integers(np.array([r.v]), scale)[0]] for r in top]


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
        seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> list[list[int]]:
    """Centroids after ``rounds``; ``vectors`` are those that ``kept_vectors`` keeps."""
    centroids = first_centroids(vectors, key, vector, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        for c, fields in totals(vectors, vector, centroids, dim, scale).items():
            centroids[c] = [s // fields[dim] for s in fields[:dim]]
    return centroids


def _long(v: int) -> int | None:
    return v if v < LONG else None


def assign(vectors: DataFrame, centroids: list[list[int]], vector: str = "embedding", dim: int = DIM,
           scale: int = SCALE) -> DataFrame:
    """Kept ``vectors`` without their components and with cluster, distance, cluster_inertia,
    inertia and centroid_sha256; columns of these names are replaced."""
    new = T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    base = vectors.drop(*new.names)
    rest = [c for c in base.columns if c != vector]
    schema = T.StructType([*[base.schema[c] for c in rest], *new.fields])
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    inertia = {c: f[dim + 1] for c, f in totals(base, vector, centroids, dim, scale).items()}
    whole = _long(sum(inertia.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in _slices(batches, vector, dim):
            cluster, distance = np.zeros(len(values), np.int32), [None] * len(values)
            for at, ints in _typed(values, scale):
                cluster[at], found = assign_rows(ints, centroids)
                for i, d in zip(at, found.tolist(), strict=True):
                    distance[i] = _long(d)
            picked = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in rest], pa.array(cluster), pa.array(distance, pa.int64()),
                 pa.array([_long(inertia[c]) for c in picked], pa.int64()), pa.array([whole] * len(picked), pa.int64()),
                 pa.array([names[c] for c in picked])], schema.names)

    return base.mapInArrow(run, schema)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Fit and assign. The kept vectors are written once; every round reads that table."""
    if dim & (dim - 1) or dim > DIM:
        raise ValueError(f"dim must be a power of two up to {DIM}")
    kept = written(kept_vectors(vectors, vector, dim), "kept-vectors")
    return assign(kept, fit(kept, key, vector, k, rounds, seed, dim, scale), vector, dim, scale)
