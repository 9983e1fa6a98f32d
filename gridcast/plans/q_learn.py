"""Registered model queries (M1-M11). Model fits are not SQL-expressible: rows-only checks,
plus the bound tests in tests/test_learn.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.learn import isotonic
from gridcast.learn import models as ml
from gridcast.learn.hist_boost import ITERATIONS, RATE
from gridcast.operators import ladder
from gridcast.operators import metrics as mx
from gridcast.plans.q_features import _target
from gridcast.plans.q_metrics import PRED_SQL
from gridcast.plans.q_timeseries import K
from gridcast.plans.registry import register
from gridcast.sources import standins as sd
from gridcast.session import cut_lineage

ML_FEATS = ["target_lag_1", "target_lag_2", "target_lag_7", "target_rolling_7", "target_rolling_30",
            "trend_dev_30", "roc_7", "log_return_lag_1", "log_return_std_14", "day_of_week", "month"]
N_TEST = 120
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a target (P2 after the windows), calendar columns and the O3 role."""
    t = _target(spark, sf_dir).where(F.col("target").isNotNull())
    t = t.withColumn("day_of_week", F.weekday("date").cast("double")).withColumn(
        "month", F.month("date").cast("double"))
    # every model query reads this table many times (fits, CV, scoring): materialise it once
    return cut_lineage(mx.chrono_split(t.select(*K, "date", "target", *ML_FEATS), K, N_TEST))


@register("elastic_net", ops="M1 M2 M3 M10 (rows-only) bench:skip")
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ml_frame(spark, sf_dir)
    model = ml.fit_elastic_net(d.where(F.col("role") == "train"), ML_FEATS)
    return model.transform(d.where(F.col("role") == "test")).select(*K, "date", "target", "prediction")


@register("quantile_boost", ops="M4 M10 (rows-only) bench:skip")
def quantile_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball-loss boosting at the reference's five quantiles, scored on the test tail."""
    d = ml_frame(spark, sf_dir)
    tr, te = d.where(F.col("role") == "train"), d.where(F.col("role") == "test").select(*K, "date", "target", *ML_FEATS)
    out = te
    for a in QUANTILES:
        m = ml.fit_quantile_boost(tr, ML_FEATS, a, n_trees=10)
        p = ml.predict_quantile_boost(m, te, out=f"q{int(a * 100):02d}").select(*K, "date", f"q{int(a * 100):02d}")
        out = out.join(p, [*K, "date"])
    return out.select(*K, "date", "target", *[f"q{int(a * 100):02d}" for a in QUANTILES])


def _strike_tables(spark: SparkSession, sf_dir: str):
    d = ml_frame(spark, sf_dir)
    grid = ladder.training_grid(d.where(F.col("role") == "train"), K, "target", step=10.0)
    return cut_lineage(ml.exploded_strikes(d, grid, K))


@register("strike_classifiers", ops="M5 L3 L8 A17 (rows-only) bench:skip")
def strike_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _strike_tables(spark, sf_dir)
    model = ml.fit_strike_classifier(x.where(F.col("role") == "train"), ML_FEATS, max_iter=ITERATIONS, step=RATE)
    te = ml.prob_of_one(model.transform(x.where(F.col("role") == "test")))
    return te.select(*K, "date", "strike", "label", "prob")


@register("calibrated_probs", ops="M6 O3 (rows-only) bench:skip")
def calibrated_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on train minus the last 60 train rows per series, an isotonic map for each series and
    strike on those 60 rows, applied to the test tail."""
    x = _strike_tables(spark, sf_dir)
    tr = x.where(F.col("role") == "train")
    tail = mx.chrono_split(tr.select(*K, "date").distinct(), K, 60).withColumnRenamed("role", "cal_role")
    tr = tr.join(tail, [*K, "date"])
    model = ml.fit_strike_classifier(tr.where(F.col("cal_role") == "train"), ML_FEATS, max_iter=ITERATIONS, step=RATE)
    cal = ml.prob_of_one(model.transform(tr.where(F.col("cal_role") == "test")))
    te = ml.prob_of_one(model.transform(x.where(F.col("role") == "test")))
    out = isotonic.calibrate(cal.select(*K, "strike", "prob", "label"),
                             te.select(*K, "date", "strike", "label", "prob"), [*K, "strike"])
    return out.select(*K, "date", "strike", "label", "prob", "calibrated_prob")


@register("strike_calibration", ops="M6", doubles=["threshold", "score", "calibrated"], sql="WITH " + PRED_SQL.split("base AS (")[0] + """
g AS (SELECT threshold, predicted_prob AS x, count(*) AS w, sum(actual_label) AS p FROM pr GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(p) OVER o AS cp FROM g
      WINDOW o AS (PARTITION BY threshold ORDER BY x ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.threshold, a.i AS a, b.i AS b, (b.cp - a.cp + a.p) / (b.cw - a.cw + a.w) AS mean
      FROM c a JOIN c b ON a.threshold = b.threshold AND a.i <= b.i),
n AS (SELECT threshold, a, b, min(mean) OVER (PARTITION BY threshold, a ORDER BY b DESC) AS least FROM m),
y AS (SELECT threshold, b AS i, max(least) AS y FROM n GROUP BY 1, 2),
k AS (SELECT threshold, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM c JOIN y USING (threshold, i)
      WINDOW o AS (PARTITION BY threshold ORDER BY x)),
f AS (SELECT threshold FROM pr GROUP BY 1 HAVING count(*) >= 20 AND min(actual_label) < max(actual_label))
SELECT threshold, row_id, predicted_prob + 0.004 AS score,
       CASE WHEN threshold NOT IN (SELECT threshold FROM f) THEN predicted_prob + 0.004 WHEN x2 IS NULL THEN y
            ELSE y + (predicted_prob + 0.004 - x) / (x2 - x) * (y2 - y) END AS calibrated
FROM pr JOIN k USING (threshold) WHERE x = predicted_prob
""")
def strike_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An isotonic map per threshold, fitted on the predictions and applied beside them (score +
    0.004), so that values between two scores are read as well."""
    p = sd.predictions(spark, sf_dir)
    moved = p.select("threshold", "row_id", (F.col("predicted_prob") + 0.004).alias("score"))
    cal = p.select("threshold", F.col("predicted_prob").alias("score"), F.col("actual_label").alias("label"))
    return isotonic.calibrate(cal, moved, ["threshold"], "score", out="calibrated")


@register("permutation_importance", ops="M7 O4 A18 (rows-only) bench:skip")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ml_frame(spark, sf_dir).where(F.col("role") == "train")
    return ml.permutation_importance(d, ML_FEATS, K, repeats=8)


@register("select_features", ops="M8 O2 O7 K3 (rows-only) bench:skip")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ml_frame(spark, sf_dir).where(F.col("role") == "train")
    imp = ml.permutation_importance(d, ML_FEATS, K, repeats=8)
    corr = mx.pairwise_corr(d, ML_FEATS)
    return ml.select_features(imp, corr)


@register("per_strike_ensemble", ops="M5 (per-strike mode) A19 A17 (rows-only) bench:skip")
def per_strike_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-classifier-per-strike ensemble (A19) on the grid of the other strike queries, with
    the reference's classifier and seeds, on the test tail."""
    return ml.score_per_strike(_strike_tables(spark, sf_dir), ML_FEATS, K)
