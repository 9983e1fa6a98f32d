"""Pairwise-complete co-moments of many columns as blocked matrix products.

One aggregate expression per pair stops at a few dozen columns (183 make 16,653 pairs). Here a task
turns its rows into a matrix with a mask of the cells that have a value and adds up six p x p
products: rows, sums, squares and products over the rows where both columns have a value. A task
emits its sums once per group, Spark adds them per pair (partial aggregation), and correlation or
covariance are expressions over that table. Sums are taken about a value of each column (its
minimum, from one aggregate before), so large offsets cost no digits and constant columns give
exact zeros.

Nulls, NaN and infinities are missing cells; a null group is a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.ordered import join_keys

HELD = 16       # groups whose sums a task holds at once
SUMS = ("n", "si", "sj", "sii", "sjj", "sij")


def _products(x: np.ndarray) -> np.ndarray:
    """The six sums for every (i, j), rows with both values only."""
    has = np.isfinite(x)
    m, z = has.astype(float), np.where(has, x, 0.0)
    s, q = z.T @ m, (z * z).T @ m
    return np.stack([m.T @ m, s, s.T, q, q.T, z.T @ z])


def comoments(df: DataFrame, features: Sequence[str], group: Sequence[str] = (),
              batch_rows: int = 4096) -> DataFrame:
    """(group..., i, j, n, si, sj, sii, sjj, sij, xi, xj) for i <= j, positions in ``features``: sums
    over the rows where both columns have a value, about the columns' origins ``xi`` and ``xj``.
    A group without rows has none."""
    group, features = list(group), list(features)
    names = [f"_x{k}" for k in range(len(features))]
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for c in (F.col(f).cast("double") for f in features)]
    rows = df.select(*group, *[c.alias(n) for c, n in zip(finite, names, strict=True)])
    least = rows.groupBy(*group).agg(F.array(*[F.coalesce(F.min(n), F.lit(0.0)) for n in names]).alias("_o"))
    if group:
        moved = join_keys(rows, least, group).select(*group, *[(F.col(n) - F.get("_o", F.lit(k))).alias(n)
                                                               for k, n in enumerate(names)])
    else:                                                # one row, as wide as the table
        origin = [float(x) for x in least.first()[0]]
        moved = rows.select(*[(F.col(n) - x).alias(n) for n, x in zip(names, origin, strict=True)])
    upper = np.triu_indices(len(features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out(key: tuple) -> pd.DataFrame:
            part = pd.DataFrame(dict(zip(SUMS, (s[upper] for s in held.pop(key)), strict=True)))
            part.insert(0, "j", upper[1].astype(np.int32))
            part.insert(0, "i", upper[0].astype(np.int32))
            for c, value in reversed(list(zip(group, key, strict=True))):
                part.insert(0, c, pd.Series([value] * len(part), dtype=object))
            return part

        for batch in batches:
            parts = batch.groupby(group, dropna=False, sort=False) if group else [((), batch)]
            for key, pdf in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                for at in range(0, len(pdf), batch_rows):
                    new = _products(pdf[names].iloc[at:at + batch_rows].to_numpy(float))
                    if key in held:
                        held[key] += new
                        continue
                    if len(held) >= HELD:
                        yield out(next(iter(held)))
                    held[key] = new
        for key in list(held):
            yield out(key)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema]
    schema = ", ".join([*kinds, "i int, j int", *[f"{s} double" for s in SUMS]])
    sums = moved.mapInPandas(run, schema).groupBy(*group, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    if group:
        sums = join_keys(sums, least, group)
    else:
        sums = sums.withColumn("_o", F.array(*[F.lit(x) for x in origin]))
    return sums.withColumns({"xi": F.get("_o", F.col("i")), "xj": F.get("_o", F.col("j"))}).drop("_o")


def _mean(s: str) -> Column:
    return F.try_divide(s, "n")


def _spread(s: str, q: str) -> Column:
    """Sum of squares about the mean; what rounding leaves of a constant counts as 0."""
    left = F.col(q) - F.col(s) * _mean(s)
    return F.when(left > 1e-12 * F.col(q), left).otherwise(0.0)


def correlations(moments: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group..., f1, f2, corr) of every pair, f1 before f2: Pearson over the rows where both have a
    value; null where a column is constant there or fewer than two rows are left."""
    names = F.array(*[F.lit(f) for f in features])
    both = F.col("sij") - F.col("si") * _mean("sj")
    return moments.where(F.col("i") < F.col("j")).select(
        *group, F.get(names, F.col("i")).alias("f1"), F.get(names, F.col("j")).alias("f2"),
        F.try_divide(both, F.sqrt(_spread("si", "sii") * _spread("sj", "sjj"))).alias("corr"))
