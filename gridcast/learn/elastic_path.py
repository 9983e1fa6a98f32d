"""Elastic net with its regularisation path, chosen by cross-validation from moments (M1-M3).

The rows are read once: median imputation, then blocked co-moments (rows, sums, products of the
features and the target) per key and fold. Everything after is a function of these few numbers: the
scaling, the penalty grids, the minima on the whole and without each fold, and the squared error on
the fold left out. Keys are fitted in parallel, one small group of moments a task; nothing is
collected. A key's group is folds x (features + 1)^2 / 2 rows, whatever the number of its rows.

Objective per key: |y - Xb|^2 / (2 n) + a r |b|_1 + a (1 - r) |b|^2 / 2 on standardised features with
an intercept; for each ratio r the penalties a run over ``n_alphas`` steps from the least one that
zeroes all coefficients down to ``eps`` times it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators import metrics as mx
from gridcast.operators.comoments import comoments
from gridcast.operators.ordered import join_keys
from gridcast.session import cut_lineage

RATIOS, N_ALPHAS, EPS, FOLDS = (0.1, 0.5, 0.9), 100, 1e-3, 5
SWEEPS, TOL = 2000, 1e-8


@dataclass
class Moments:
    """Rows, sums and products about one origin; the target is the last column."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.ss - other.ss)

    def centred(self) -> np.ndarray:
        return self.ss - np.outer(self.s, self.s) / self.n


def moments_by_fold(pdf: pd.DataFrame, p: int, fold: str = "fold") -> tuple[list[Moments], np.ndarray]:
    """The moments of each fold about a common origin, and that origin."""
    origin, out = None, []
    for _, part in pdf.sort_values([fold, "i", "j"]).groupby(fold, sort=True):
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        diag = part[i == j]
        here, n, s = diag["xi"].to_numpy(), float(diag["n"].iloc[0]), diag["si"].to_numpy()
        ss = np.zeros((p, p))
        ss[i, j] = ss[j, i] = part["sij"].to_numpy()
        origin = here if origin is None else origin
        d = here - origin
        out.append(Moments(n, s + n * d, ss + np.outer(d, s) + np.outer(s, d) + n * np.outer(d, d)))
    return out, origin


def descend(q: np.ndarray, c: np.ndarray, l1: float, l2: float, b: np.ndarray) -> np.ndarray:
    """Minimum of b'qb/2 - c'b + l1 |b|_1 + l2 |b|^2 / 2, from ``b``: an active set with signs, solved
    exactly. A step goes to the minimum for the signs at hand, or as far as the first coefficient that
    becomes 0 on the way and leaves the set; at the minimum the feature with the greatest gradient
    above l1 comes in. So the work depends on the features that come and go and not on how much
    they are correlated, as that of coordinate descent does, which only takes over where equal
    features without a ridge keep a set from being solved."""
    usable = np.diag(q) > 0
    b = np.where(usable, b, 0.0)
    sign = np.sign(b)
    limit = l1 + 1e-10 * max(np.abs(c).max(initial=0.0), l1)
    for _ in range(50 + 10 * len(c)):
        on = np.flatnonzero(sign)
        if len(on):
            try:
                goal = np.linalg.solve(q[np.ix_(on, on)] + l2 * np.eye(len(on)), c[on] - l1 * sign[on])
            except np.linalg.LinAlgError:
                break
            crossed = goal * sign[on] <= 0
            if crossed.any():
                gap = np.abs(b[on] - goal)
                way = np.where(crossed, np.abs(b[on]) / np.where(gap > 0, gap, 1.0), np.inf)
                first = int(way.argmin())
                b[on] += way[first] * (goal - b[on])
                b[on[first]] = sign[on[first]] = 0.0
                continue
            b[on] = goal
        left = np.where(usable & (sign == 0), c - q @ b, 0.0)
        j = int(np.abs(left).argmax()) if len(left) else 0
        if not len(left) or abs(left[j]) <= limit:
            return b
        sign[j] = np.sign(left[j])
    return sweep(q, c, l1, l2, np.where(np.isfinite(b), b, 0.0))


def sweep(q: np.ndarray, c: np.ndarray, l1: float, l2: float, b: np.ndarray) -> np.ndarray:
    """Coordinate descent for the same, from ``b``."""
    b, left, diag = b.copy(), c - q @ b, np.diag(q)
    active = np.flatnonzero(diag > 0)
    limit = TOL * np.sqrt(max(diag.max(initial=0.0), 1e-300))
    for _ in range(SWEEPS):
        worst = 0.0
        for j in active:
            rho = left[j] + diag[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            step = new - b[j]
            if step:
                left -= q[:, j] * step
                b[j] = new
                worst = max(worst, abs(step) * np.sqrt(diag[j]))
        if worst <= limit:
            break
    return b


def fit_moments(folds: list[Moments], ratios: Sequence[float] = RATIOS, n_alphas: int = N_ALPHAS,
                eps: float = EPS) -> dict:
    """Chosen ratio and penalty, intercept and coefficients about the moments' origin."""
    whole = Moments(sum(f.n for f in folds), sum(f.s for f in folds), sum(f.ss for f in folds))
    mean, cov = whole.s / whole.n, whole.centred()
    spread = np.diag(cov)[:-1] / whole.n
    scale = np.where(spread > 1e-12 * np.diag(whole.ss)[:-1] / whole.n, np.sqrt(np.abs(spread)), 1.0)
    live = (spread > 1e-12 * np.diag(whole.ss)[:-1] / whole.n).astype(float)

    def parts(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        c = m.centred()
        return c[:-1, :-1] / np.outer(scale, scale) * np.outer(live, live), c[:-1, -1] / scale * live

    def error(m: Moments, beta: np.ndarray, b0: float) -> float:
        w = np.append(-beta, 1.0)
        return (w @ m.ss @ w - 2 * b0 * (w @ m.s) + m.n * b0 * b0) / m.n

    grid = {}
    top = np.abs(parts(whole)[1]).max(initial=0.0) / whole.n
    for r in ratios:
        grid[r] = np.geomspace(top / r, top / r * eps, n_alphas) if top > 0 else np.zeros(n_alphas)
    scores = {r: np.zeros(n_alphas) for r in ratios}
    used = [f for f in folds if whole.n - f.n > 0 and len(folds) > 1]
    for f in used:
        train = whole - f
        q, c = parts(train)
        for r in ratios:
            b = np.zeros(len(c))
            for k, a in enumerate(grid[r]):
                b = descend(q, c, train.n * a * r, train.n * a * (1 - r), b)
                beta = b / scale
                scores[r][k] += error(f, beta, (train.s[-1] - train.s[:-1] @ beta) / train.n) / len(used)
    _, ratio, k = min(((scores[r][int(scores[r].argmin())], at, int(scores[r].argmin())) for at, r in enumerate(ratios)))
    ratio = ratios[ratio]
    q, c = parts(whole)
    b = np.zeros(len(c))
    for a in grid[ratio][:k + 1]:
        b = descend(q, c, whole.n * a * ratio, whole.n * a * (1 - ratio), b)
    beta = b / scale
    return {"l1_ratio": float(ratio), "alpha": float(grid[ratio][k]), "cv_mse": float(scores[ratio][k]),
            "intercept": float(mean[-1] - mean[:-1] @ beta), "coefs": beta}


def blocks_in_order(df: DataFrame, keys: Sequence[str], folds: int, date: str, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``fold``: ``folds`` contiguous blocks a key by date, the first ones a row longer."""
    s = mx._numbered(df, keys, date, max_rows)
    at, size = F.col("_rn") - 1, F.floor(F.col("_n") / folds)
    longer = F.col("_n") - size * folds
    fold = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(
        longer + F.floor(F.try_divide(at - longer * (size + 1), size)))
    return s.withColumn("fold", fold.cast("int")).drop("_rn", "_n")


@dataclass
class ElasticNetPaths:
    """One row per key: ratio, alpha, cv_mse, intercept, coefs, medians (in the order of ``features``)."""

    models: DataFrame
    features: list[str]
    keys: list[str]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction of its key's model; null for a key that has none."""
        small = self.models.select(*self.keys, F.struct("intercept", "coefs", "medians").alias("_m"))
        value = F.col("_m.intercept")
        for k, f in enumerate(self.features):
            value = value + F.get("_m.coefs", F.lit(k)) * F.coalesce(F.col(f).cast("double"), F.get("_m.medians", F.lit(k)))
        j = join_keys(df.drop(out), small, self.keys, "left")
        return j.select(*[c for c in df.columns if c != out], value.alias(out))

    def save(self, path: str) -> None:
        self.models.write.mode("overwrite").parquet(path)


def fit_paths(train: DataFrame, features: Sequence[str], label: str = "target", keys: Sequence[str] = ("series_id",),
              date: str = "date", ratios: Sequence[float] = RATIOS, n_alphas: int = N_ALPHAS, eps: float = EPS,
              folds: int = FOLDS) -> ElasticNetPaths:
    """Fit every key's path. Null and non-finite features take the key's median (0 where a key has no
    value); rows without a finite target do not count; a key with a single row gets its mean."""
    features, keys = list(features), list(keys)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    rows = train.select(*keys, date, finite(F.col(label).cast("double")).alias("_y"),
                        *[finite(F.col(f).cast("double")).alias(f) for f in features]).where("_y IS NOT NULL")
    rows = cut_lineage(blocks_in_order(rows, keys, folds, date))
    # a key's panel has a row per day, which bounds the buffers of the exact medians
    medians = cut_lineage(rows.groupBy(*keys).agg(F.array(*[F.coalesce(F.median(f), F.lit(0.0)) for f in features]).alias("medians")))
    filled = join_keys(rows, medians, keys).select(
        *keys, "fold", *[F.coalesce(F.col(f), F.get("medians", F.lit(k))).alias(f) for k, f in enumerate(features)], "_y")
    sums = comoments(filled, [*features, "_y"], [*keys, "fold"])
    p = len(features) + 1
    ratios = list(ratios)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, origin = moments_by_fold(pdf, p)
        m = fit_moments(parts, ratios, n_alphas, eps)
        m["intercept"] += origin[-1] - origin[:-1] @ m["coefs"]
        m["coefs"] = m["coefs"].tolist()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **m}])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    # tasks by the number of keys: a key's moments are few bytes, but its fits take time
    tasks = max(1, min(medians.count(), 16 * train.sparkSession.sparkContext.defaultParallelism))
    models = sums.repartition(tasks, *keys).groupBy(*keys).applyInPandas(
        fit, f"{kinds}, l1_ratio double, alpha double, cv_mse double, intercept double, coefs array<double>")
    return ElasticNetPaths(cut_lineage(join_keys(models, medians, keys)), features, keys)


def load_paths(models: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id",)) -> ElasticNetPaths:
    return ElasticNetPaths(models, list(features), list(keys))
