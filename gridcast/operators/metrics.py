"""Evaluation metrics as grouped SQL aggregates (A13-A18), splits (O3, O4) and pairwise
correlation with the greedy prune (A8, O7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.comoments import comoments, correlations
from gridcast.operators.ordered import join_keys
from gridcast.operators.quantiles import exact_quantiles
from gridcast.operators.scan import Scan, prefix_scan
from gridcast.session import cut_lineage


def robust_spread(df: DataFrame, group: Sequence[str], resid: str, floor: float = 0.05,
                  scale: float = 1.4826, max_rows: int = 1_000_000) -> DataFrame:
    """1.4826 * median(|r - median(r)|) floored (A13). Two selections of the exact median (linear,
    as NumPy) by radix digits, joined on the group (one row per group)."""
    rows = cut_lineage(df.select(*group, resid))
    med = cut_lineage(exact_quantiles(rows, group, resid, [0.5], max_rows).withColumnRenamed("q0", "median_resid"))
    dev = join_keys(rows, med, list(group)).withColumn("_dev", F.abs(F.col(resid) - F.col("median_resid")))
    mad = exact_quantiles(dev, group, "_dev", [0.5], max_rows)
    return join_keys(med, mad, list(group)).select(
        *group, "median_resid", F.greatest(F.lit(scale) * F.col("q0"), F.lit(floor)).alias("residual_std"))


def regression_metrics(df: DataFrame, group: Sequence[str], y: str, yhat: str) -> DataFrame:
    """MAE, RMSE, R^2 per group (A14); R^2 = 1 - SSE / (n * var_pop(y))."""
    e = F.col(y) - F.col(yhat)
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"),
        F.var_pop(F.col(y)).alias("_vp"))
    return g.select(*group, "n", "mae", "rmse",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("n") * F.col("_vp"))).alias("r2"))


def binary_metrics(df: DataFrame, group: Sequence[str], prob: str = "predicted_prob",
                   label: str = "actual_label", cut: float = 0.5, max_rows: int = 1_000_000) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0), ROC-AUC with tied scores at
    average rank, Brier score and class counts, per group; groups with one class only are
    dropped (A15, A17).

    AUC is computed from counts per distinct score: rows are first reduced to
    (group, score) -> (#pos, #neg) with partial aggregation, then a running sum of negatives
    below each score gives the Mann-Whitney statistic. The sum is a segmented prefix scan over
    the distinct scores, so neither the rows nor the scores of a hot group are sorted in one task.
    """
    y, p = F.col(label), F.col(prob)
    pred = (p >= cut).cast("int")
    base = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(y).cast("bigint").alias("n_test_pos"),
        F.count_if((pred == 1) & (y == 1)).alias("_tp"), F.count_if((pred == 1) & (y == 0)).alias("_fp"),
        F.count_if((pred == 0) & (y == 1)).alias("_fn"), F.count_if((pred == 0) & (y == 0)).alias("_tn"),
        F.avg((p - y) * (p - y)).alias("brier"))
    base = base.where((F.col("n_test_pos") > 0) & (F.col("n_test_pos") < F.col("n_test")))
    by_score = cut_lineage(df.groupBy(*group, prob).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg")))
    by_score = prefix_scan(by_score, group, [prob], {"_below": Scan("sum", "_neg", inclusive=False)}, max_rows=max_rows)
    by_score = by_score.withColumn("_below", F.coalesce("_below", F.lit(0)))
    u = by_score.groupBy(*group).agg(
        F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg"))).alias("_u"))
    j = base.join(u, list(group))
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    j = j.select(*group, "n_test", "n_test_pos", ((tp + tn) / F.col("n_test")).alias("accuracy"),
                 prec.alias("precision"), rec.alias("recall"),
                 (F.col("_u") / (F.col("n_test_pos") * (F.col("n_test") - F.col("n_test_pos")))).alias("roc_auc"),
                 "brier")
    return j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro_metrics(per_group: DataFrame, cols: Sequence[str] = ("accuracy", "precision", "recall",
                                                               "f1", "roc_auc", "brier")) -> DataFrame:
    """Average of per-strike metrics over the strikes that had both classes; zeros if none
    (A16)."""
    return per_group.agg(F.count(F.lit(1)).alias("n_strikes"),
                         *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in cols])


def importance_summary(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Mean importance and number of folds with positive importance per feature."""
    return imp.groupBy(feature).agg(F.avg(value).alias("mean_importance"),
                                    F.count_if(F.col(value) > 0).alias("positive_folds"))


# --------------------------------------------------------------------------- O3 / O4

def _numbered(df: DataFrame, keys: Sequence[str], date: str, max_rows: int) -> DataFrame:
    """``df`` with _rn, the place of a row among its key's rows by date, and _n, their number."""
    return prefix_scan(df, keys, [date], {"_rn": Scan("count")}, {"_n": Scan("count")}, max_rows)


def chrono_split(df: DataFrame, keys: Sequence[str], n_test: int, date: str = "date",
                 max_rows: int = 1_000_000) -> DataFrame:
    """Last ``n_test`` rows per key are 'test', the rest 'train' (O3). Numbered by a segmented
    prefix scan, so a key may hold any share of the rows."""
    s = _numbered(df, keys, date, max_rows)
    return s.withColumn("role", F.when(F.col("_rn") > F.col("_n") - n_test, "test").otherwise("train")).drop("_rn", "_n")


def walk_forward_folds(df: DataFrame, keys: Sequence[str], n_splits: int = 5,
                       date: str = "date", max_rows: int = 1_000_000, position: str | None = None) -> DataFrame:
    """Expanding-window folds (O4, TimeSeriesSplit): test size t = n div (K+1); fold i tests
    rows (n-(K-i)t, n-(K-i-1)t] and trains on every row before. Rows are exploded to
    (row, fold, role); rows in no fold are dropped. With ``position`` test rows get their place
    0..t-1 in the fold under that name, and t as _size."""
    s = _numbered(df, keys, date, max_rows)
    t = (F.col("_n") / F.lit(n_splits + 1)).cast("long")
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    s = s.select("*", t.alias("_t"), F.explode(folds).alias("fold"))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * F.col("_t")
    role = (F.when(F.col("_rn") <= start, "train")
            .when(F.col("_rn") <= start + F.col("_t"), "test"))
    if position is not None:
        s = s.withColumns({position: F.col("_rn") - start - 1, "_size": F.col("_t")})
    s = s.withColumn("role", role).where(F.col("role").isNotNull() & (F.col("_t") > 0))
    return s.drop("_rn", "_n", "_t")


# --------------------------------------------------------------------------- A8 / O7

#: Features up to which pairs are aggregate expressions.
WIDE = 16


def pairwise_corr(df: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlation for every feature pair (A8), long form
    (f1, f2, corr). Up to ``WIDE`` features all pairs are aggregates of ONE grouped aggregation
    (partial aggregation map-side), so no row x pair expansion is shuffled; more features go
    through blocked co-moment matrices. A constant column gives NULL (the reference keeps such a
    feature), not a division error."""
    if len(features) > WIDE:
        return correlations(comoments(df, features, group), features, group)
    aggs = []
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    for a, b in pairs:
        ca = F.when(F.col(b).isNotNull(), F.col(a))
        cb = F.when(F.col(a).isNotNull(), F.col(b))
        aggs.append(F.try_divide(F.covar_samp(ca, cb), F.stddev_samp(ca) * F.stddev_samp(cb))
                    .alias(f"{a}|{b}"))
    wide = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"),
                                         F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]))
    return wide.select(*group, stack.alias("_p")).select(*group, "_p.f1", "_p.f2", "_p.corr")


def greedy_prune(corr: DataFrame, order: DataFrame, max_abs: float = 0.95) -> DataFrame:
    """Greedy correlation prune in importance order (O7): a feature is kept unless its |corr|
    with an already-kept feature exceeds ``max_abs``. Input sizes are features and feature
    pairs (bounded by the candidate count, independent of rows); the fold is a Catalyst
    ``aggregate`` over the ordered feature array, no Python UDF.

    ``order``: (feature, rank). ``corr``: (f1, f2, corr)."""
    conflicts = corr.where(F.abs(F.col("corr")) > max_abs).select(
        F.col("f1").alias("a"), F.col("f2").alias("b"))
    conflicts = conflicts.unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b")))
    per = order.join(conflicts.groupBy("a").agg(F.collect_set("b").alias("confl")),
                     order.feature == F.col("a"), "left").select("feature", "rank", F.coalesce(
                         "confl", F.array().cast("array<string>")).alias("confl"))
    one = per.agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "confl"))).alias("fs"))
    kept = F.aggregate(F.col("fs"), F.array().cast("array<string>"),
                       lambda acc, x: F.when(F.size(F.array_intersect(acc, x["confl"])) > 0, acc)
                       .otherwise(F.array_union(acc, F.array(x["feature"]))))
    out = one.select(F.explode("fs").alias("f"), kept.alias("kept"))
    return out.select(F.col("f.feature").alias("feature"), F.col("f.rank").alias("rank"),
                      F.array_contains("kept", F.col("f.feature")).alias("kept"))
