"""Model fitting on Spark ML.

Every fit but the per-strike one (grouped, a model for each series and strike) is a distributed
Spark ML fit over the pooled panel (all series in one model, the series id as an indexed feature);
nothing but small metric / importance tables is ever
collected. Lineage of iterative loops is cut with reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.learn import elastic_path, hist_boost
from gridcast.operators import ladder
from gridcast.operators import metrics as mx
from gridcast.session import cut_lineage


#: Swap-or-not rounds: beyond 2 log2(n) + 16 for any table here, more mixing than an importance needs.
ROUNDS = 48


def non_null_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Drop all-null candidate columns (the median imputer cannot fill them). One aggregate
    returning one row of counts."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in features]).collect()[0]
    return [c for c in features if counts[c] > 0]


def _prep_stages(features: Sequence[str], series: str | None):
    imp_out = [f"{c}__imp" for c in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=imp_out)]
    cols = list(imp_out)
    if series:
        stages.append(StringIndexer(inputCol=series, outputCol=f"{series}__idx", handleInvalid="keep"))
        cols.append(f"{series}__idx")
    stages.append(VectorAssembler(inputCols=cols, outputCol="features"))
    return stages


def fit_elastic_net(train: DataFrame, features: Sequence[str], label: str = "target",
                    l1_ratios: Sequence[float] = elastic_path.RATIOS, folds: int = elastic_path.FOLDS,
                    keys: Sequence[str] = ("series_id",), date: str = "date") -> elastic_path.ElasticNetPaths:
    """Median impute + standard scale + elastic net (M1-M3), one model per key: the l1 ratio and the
    penalty are chosen on a path of penalties by K-fold CV in time order, all from moments that one
    pass collects."""
    return elastic_path.fit_paths(train, features, label, keys, date, l1_ratios, folds=folds)


def fit_quantile_boost(train: DataFrame, features: Sequence[str], alpha: float, label: str = "target",
                       n_trees: int = 20, learning_rate: float = 0.1, max_depth: int = 3,
                       series: str | None = "series_id", seed: int = 42, checkpoint_every: int = 5):
    """Gradient boosting for the pinball loss at quantile ``alpha`` (M4).

    Spark's GBTRegressor has only squared / absolute loss, so the loop is written out:
    start from the alpha-quantile; each round fits a depth-limited DecisionTreeRegressor to
    the pinball negative gradient (alpha if y > F else alpha - 1) and sets each leaf's step to
    the alpha-quantile of the residuals in that leaf (Friedman 2001) - a groupBy on the leaf id.
    Returns (prep_model, f0, [(tree_model, leaf_values_df)], learning_rate).
    """
    features = non_null_features(train, features)
    prep = Pipeline(stages=_prep_stages(features, series)).fit(train)
    d = prep.transform(train).select("features", F.col(label).alias("_y"))
    f0 = d.agg(F.percentile("_y", alpha).alias("q")).collect()[0]["q"]
    d = cut_lineage(d.withColumn("_f", F.lit(float(f0))))
    trees = []
    for i in range(n_trees):
        r = F.col("_y") - F.col("_f")
        d = d.withColumn("_g", F.when(r > 0, F.lit(alpha)).otherwise(F.lit(alpha - 1.0)))
        dt = DecisionTreeRegressor(featuresCol="features", labelCol="_g", maxDepth=max_depth,
                                   leafCol="_leaf", seed=seed + i)
        tm = dt.fit(d)
        scored = tm.transform(d)
        leaf = scored.groupBy("_leaf").agg(F.percentile(F.col("_y") - F.col("_f"), alpha).alias("_step"))
        leaf = cut_lineage(leaf)   # one row per leaf: at most 2^depth rows
        d = (scored.join(F.broadcast(leaf), "_leaf", "left")
             .select("features", "_y", (F.col("_f") + learning_rate * F.coalesce("_step", F.lit(0.0))).alias("_f")))
        if (i + 1) % checkpoint_every == 0:
            d = cut_lineage(d)
        trees.append((tm, leaf))
    return prep, float(f0), trees, learning_rate


def predict_quantile_boost(model, df: DataFrame, out: str = "prediction") -> DataFrame:
    prep, f0, trees, lr = model
    d = prep.transform(df).withColumn(out, F.lit(f0))
    for tm, leaf in trees:
        d = tm.transform(d).join(F.broadcast(leaf), "_leaf", "left").withColumn(
            out, F.col(out) + lr * F.coalesce("_step", F.lit(0.0))).drop("_leaf", "_step", "prediction")
    return d.select(*df.columns, out)   # drop the prep stage's columns so predictions chain


def exploded_strikes(rows: DataFrame, grid: DataFrame, keys: Sequence[str], label: str = "target",
                     base: str = "target_lag_1") -> DataFrame:
    """(row x strike) table for a pooled strike classifier (L8, M5): label y >= k and the
    strike distance to the last value as an extra feature; class-balanced weights
    n / (2 n_class) per strike (sklearn's 'balanced')."""
    x = rows.join(grid, list(keys)).withColumn("label", (F.col(label) >= F.col("strike")).cast("double"))
    x = x.withColumn("strike_gap", F.col("strike") - F.col(base))
    cnt = ladder.class_counts(rows, grid, list(keys), label).select(
        *keys, "strike", F.col("n").alias("_n"), F.col("n_pos").alias("_p"))
    x = x.join(cnt, [*keys, "strike"])
    w = F.when(F.col("label") == 1.0, F.col("_n") / (2.0 * F.col("_p"))).otherwise(
        F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    # strikes with a single class are skipped, as the reference does
    return x.where((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).withColumn("weight", w).drop("_n", "_p")


def fit_strike_classifier(x: DataFrame, features: Sequence[str], seed: int = 42, max_iter: int = 30,
                          series: str | None = "series_id", step: float = 0.1) -> PipelineModel:
    """One pooled, class-weighted GBT over all strikes (M5)."""
    features = non_null_features(x, [*features, "strike_gap"])
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
                        maxDepth=3, stepSize=step, seed=seed)
    return Pipeline(stages=[*_prep_stages(features, series), gbt]).fit(x)


def prob_of_one(df: DataFrame, out: str = "prob") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(out, vector_to_array("probability")[1])


def permuted_position(pos: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of 0..n-1 for any n, without sorting: swap-or-not rounds. Each round pairs
    x with k - x mod n for a keyed k and swaps the pair if a keyed bit of its larger member says so,
    so every round, and their composition, is a permutation."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        bit = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pos.cast("long"), swap)


def permutation_importance(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id",),
                           label: str = "target", n_splits: int = 5, repeats: int = 8, seed: int = 42,
                           max_iter: int = 15) -> DataFrame:
    """Walk-forward permutation importance (M7): per fold a quick GBTRegressor on the rows before,
    then the fold's rows scored with each feature permuted in turn. The permutation of a repeat is a
    keyed bijection of the rows' positions in their key's fold, so the values it brings come by one
    equi-join on the position: no rows are sorted, and no feature x repeat copies are shuffled (a
    row's copies for the features are made where it is scored). Importance = MAE(permuted) -
    MAE(base) per (fold, feature), the mean over repeats; the caller summarises folds (A18)."""
    keys, features = list(keys), list(features)
    folds = cut_lineage(mx.walk_forward_folds(df, keys, n_splits, position="_pos"))
    out = None
    for i in range(n_splits):
        tr = folds.where((F.col("fold") == i) & (F.col("role") == "train"))
        te = folds.where((F.col("fold") == i) & (F.col("role") == "test")).select(
            *keys, label, "_pos", "_size", *[F.col(f).cast("double").alias(f) for f in features])
        gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=4,
                           stepSize=0.1, seed=seed + i)
        model = Pipeline(stages=[*_prep_stages(non_null_features(tr, features), None), gbt]).fit(tr)
        copy = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
        moved = te.select("*", copy.alias("_rep")).withColumn("_src", permuted_position(
            F.col("_pos"), F.col("_size"), F.xxhash64(*keys, F.lit(seed), F.lit(i), F.col("_rep"))))
        source = te.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_pos").alias("_src_pos"),
                           F.struct(*features).alias("_other"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
        pairs = moved.join(source, [*same, F.col("_src") == F.col("_src_pos")])
        # one copy a feature, in the task that scores it; the base copy of a row comes once
        turns = F.array(*[F.lit(f) for f in features])
        permuted = pairs.select(label, "_other", *features, F.explode(turns).alias("_feat")).select(
            label, "_feat", *[F.when(F.col("_feat") == f, F.col(f"_other.{f}")).otherwise(F.col(f)).alias(f) for f in features])
        base = te.select(label, F.lit("__base__").alias("_feat"), *features)
        mae = (model.transform(permuted.unionByName(base)).groupBy("_feat")
               .agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("mae")))
        mae = cut_lineage(mae)                           # a row a feature
        only = mae.where(F.col("_feat") == "__base__").select(F.col("mae").alias("_b"), F.lit(i).alias("fold"))
        imp = mae.where(F.col("_feat") != "__base__").withColumn("fold", F.lit(i)).join(F.broadcast(only), "fold").select(
            F.col("_feat").alias("feature"), "fold", (F.col("mae") - F.col("_b")).alias("importance"))
        out = imp if out is None else out.unionByName(imp)
    return out


def select_features(imp: DataFrame, corr: DataFrame, min_positive_folds: int = 3, top_n: int = 30,
                    max_abs_corr: float = 0.95) -> DataFrame:
    """Stable features (>= 3 positive folds and mean > 0) sorted by importance (name breaks
    ties), greedy correlation prune, top N; when nothing is stable, every feature is kept
    (M8, O2, O7)."""
    s = mx.importance_summary(imp)
    stable = s.where((F.col("positive_folds") >= min_positive_folds) & (F.col("mean_importance") > 0))
    n_stable = stable.count()
    cand = stable if n_stable > 0 else s
    # the ranking windows below run over the candidate feature list (bounded by the number
    # of candidate columns, not by rows), so one partition is the right size
    order = cand.select("feature", F.row_number().over(
        Window.orderBy(F.col("mean_importance").desc(), F.col("feature"))).alias("rank"))
    pruned = mx.greedy_prune(corr, order, max_abs_corr).where("kept")
    top = pruned.select("feature", F.row_number().over(Window.orderBy("rank")).alias("rank"))
    return top.where(F.col("rank") <= top_n).join(s, "feature")


def save_model(model: PipelineModel, path: str) -> None:
    """Spark ML writer (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Load a saved pipeline; None when its path is absent. Any other failure is raised."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - the kind depends on the file system
        if "does not exist" in str(exc) or "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def ensemble_blend(pred_cols: Sequence[str], meta_col: str | None = None, weight: float = 0.0):
    """Ensemble member mean, optionally blended with a meta model: (1 - w) mean + w meta.
    A row expression over the members' prediction columns (wide form)."""
    mean = sum((F.col(c) for c in pred_cols), F.lit(0.0)) / float(len(pred_cols))
    if meta_col is None or weight == 0.0:
        return mean
    return (1.0 - weight) * mean + weight * F.col(meta_col)


def score_per_strike(x: DataFrame, features: Sequence[str], keys: Sequence[str], seeds=(42, 7961, 15880),
                     iterations: int = hist_boost.ITERATIONS, label: str = "label") -> DataFrame:
    """The reference's one-classifier-per-strike ensemble (M5, ``per_strike=True``, A19): for each
    series and strike of the (row x strike) table the test rows with ``prob``, the mean of one
    classifier per seed fitted on the train rows. A grouped job with a task's group bounded by a
    series' days; strikes with one class among the train rows are skipped (A17). Up to
    hist_boost.STOP_ROWS train rows the members do not depend on the seed and are fitted once."""
    features, cols = list(features), [*keys, "date", "strike", label]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        y = train[label].to_numpy(float)
        if len(np.unique(y)) < 2:
            return test.iloc[:0][cols].assign(prob=np.zeros(0))
        a, b = train[features].to_numpy(float), test[features].to_numpy(float)
        members = [hist_boost.fit_predict(a, y, b, s, iterations)
                   for s in (seeds if len(y) > hist_boost.STOP_ROWS else seeds[:1])]
        return test[cols].assign(prob=np.mean(members, axis=0))

    rows = x.select(*cols, "role", *features)
    groups = rows.select(*keys, "strike").distinct().count()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema)
    return (rows.repartition(max(1, groups), *keys, "strike").groupBy(*keys, "strike")
            .applyInPandas(score, f"{schema}, prob double"))
