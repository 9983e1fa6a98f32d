"""Registered queries: splits, evaluation metrics, correlation and prune (O3, O4, A8, O7,
A13-A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators import metrics as mx
from gridcast.plans import sqlparts as S
from gridcast.plans.q_features import FLAG_COLS, TARGET_SQL, _target
from gridcast.plans.q_timeseries import K
from gridcast.plans.registry import register
from gridcast.sources import standins as sd


@register("chrono_split", ops="O3", sql=f"""
WITH {S.RD}
SELECT series_id, date,
  CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 120 THEN 'test' ELSE 'train' END AS role
FROM rd
""")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir).select(*K, "date")
    return mx.chrono_split(rd, K, 120)


@register("walk_forward_folds", ops="O4", sql=f"""
WITH {S.RD},
s AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM rd),
f AS (SELECT s.*, n // 6 AS t, fold FROM s, (SELECT unnest(range(0, 5)) AS fold) fs),
r AS (SELECT series_id, date, CAST(fold AS INTEGER) AS fold,
        CASE WHEN rn <= n - (5 - fold) * t THEN 'train'
             WHEN rn <= n - (5 - fold) * t + t THEN 'test' END AS role, t FROM f)
SELECT series_id, date, fold, role FROM r WHERE role IS NOT NULL AND t > 0
""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir).select(*K, "date")
    return mx.walk_forward_folds(rd, K, 5).withColumn("fold", F.col("fold").cast("int"))


@register("regression_metrics", ops="A14", doubles=["mae", "rmse", "r2"], sql=TARGET_SQL + """
, e AS (SELECT series_id, target AS y, target_rolling_7 AS yhat FROM t
        WHERE target IS NOT NULL AND target_rolling_7 IS NOT NULL)
SELECT series_id, count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
       1.0 - sum((y - yhat) * (y - yhat)) / nullif(count(*) * var_pop(y), 0) AS r2
FROM e GROUP BY 1
""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7-day moving average as the prediction of the day's value, per series."""
    t = _target(spark, sf_dir)
    return mx.regression_metrics(t, K, "target", "target_rolling_7")


@register("robust_spread", ops="A13", doubles=["median_resid", "residual_std"], sql=TARGET_SQL + """
, e AS (SELECT series_id, target - target_rolling_7 AS r FROM t
        WHERE target IS NOT NULL AND target_rolling_7 IS NOT NULL),
m AS (SELECT series_id, median(r) AS median_resid FROM e GROUP BY 1),
d AS (SELECT e.series_id, median(abs(e.r - m.median_resid)) AS mad FROM e JOIN m USING (series_id) GROUP BY 1)
SELECT m.series_id, m.median_resid, greatest(1.4826 * d.mad, 0.05) AS residual_std
FROM m JOIN d USING (series_id)
""")
def robust_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _target(spark, sf_dir).where(F.col("target").isNotNull() & F.col("target_rolling_7").isNotNull())
    return mx.robust_spread(t.withColumn("r", F.col("target") - F.col("target_rolling_7")), K, "r")


PRED_SQL = """
pr AS (
  SELECT CAST(t.threshold AS DOUBLE) AS threshold, e.event_id AS row_id,
         CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 100.0 AS predicted_prob,
         CAST(e.value > CAST(t.threshold AS DOUBLE) AS INTEGER) AS actual_label
  FROM events e, (VALUES (25.0), (50.0), (100.0), (200.0), (400.0)) t(threshold)),
base AS (
  SELECT threshold, count(*) AS n_test, CAST(sum(actual_label) AS BIGINT) AS n_test_pos,
    count_if(predicted_prob >= 0.5 AND actual_label = 1) AS tp, count_if(predicted_prob >= 0.5 AND actual_label = 0) AS fp,
    count_if(predicted_prob < 0.5 AND actual_label = 1) AS fn, count_if(predicted_prob < 0.5 AND actual_label = 0) AS tn,
    avg((predicted_prob - actual_label) * (predicted_prob - actual_label)) AS brier
  FROM pr GROUP BY 1),
bs AS (SELECT threshold, predicted_prob, CAST(sum(actual_label) AS DOUBLE) AS pos,
              CAST(sum(1 - actual_label) AS DOUBLE) AS neg FROM pr GROUP BY 1, 2),
bb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY threshold ORDER BY predicted_prob
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bs),
u AS (SELECT threshold, sum(pos * (below + 0.5 * neg)) AS u FROM bb GROUP BY 1),
pm AS (
  SELECT b.threshold, b.n_test, b.n_test_pos, (b.tp + b.tn) / b.n_test AS accuracy,
    CASE WHEN b.tp + b.fp > 0 THEN b.tp / (b.tp + b.fp) ELSE 0.0 END AS precision,
    CASE WHEN b.tp + b.fn > 0 THEN b.tp / (b.tp + b.fn) ELSE 0.0 END AS recall,
    u.u / (b.n_test_pos * (b.n_test - b.n_test_pos)) AS roc_auc, b.brier
  FROM base b JOIN u USING (threshold)
  WHERE b.n_test_pos > 0 AND b.n_test_pos < b.n_test),
bm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pm)
"""

BIN_D = ["threshold", "accuracy", "precision", "recall", "roc_auc", "brier", "f1"]


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.binary_metrics(sd.predictions(spark, sf_dir), ["threshold"])


@register("binary_metrics", ops="A15 A17", doubles=BIN_D, sql="WITH " + PRED_SQL + " SELECT * FROM bm")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir)


MAC = ["accuracy", "precision", "recall", "f1", "roc_auc", "brier"]


@register("macro_metrics", ops="A16", doubles=[f"avg_{c}" for c in MAC], sql="WITH " + PRED_SQL + f"""
SELECT count(*) AS n_strikes, {", ".join(f"coalesce(avg({c}), 0.0) AS avg_{c}" for c in MAC)} FROM bm
""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.macro_metrics(_binary(spark, sf_dir))


CORR_FEATS = ["target_lag_1", "target_lag_2", "target_lag_7", "target_rolling_7", "target_rolling_30",
              "log_return_lag_1", "log_return_std_30"]


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_FEATS) for b in CORR_FEATS[i + 1:]]
    parts = []
    for a, b in pairs:
        ca = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
        cb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, covar_samp({ca}, {cb}) / "
                     f"nullif(stddev_samp({ca}) * stddev_samp({cb}), 0) AS corr FROM t")
    return TARGET_SQL + "\n UNION ALL ".join(parts)


@register("pairwise_corr", ops="A8 J12", doubles=["corr"], sql=_corr_sql())
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.pairwise_corr(_target(spark, sf_dir), CORR_FEATS)


#: The whole target block: what the prune sees where no list of candidates is given.
PANEL_FEATS = [c for c in FLAG_COLS if c != "target"]


def _panel_corr_sql() -> str:
    rank = ", ".join(f"('{f}', {i})" for i, f in enumerate(PANEL_FEATS))
    return TARGET_SQL + f""",
o AS (SELECT * FROM (VALUES {rank}) v(f, rank)),
r AS (SELECT row_number() OVER () AS row, {", ".join(PANEL_FEATS)} FROM t WHERE target IS NOT NULL),
l AS (SELECT row, f, v FROM r UNPIVOT (v FOR f IN ({", ".join(PANEL_FEATS)}))),
x AS (SELECT l.row, o.rank, o.f, l.v FROM l JOIN o USING (f)),
pc AS (SELECT a.f AS f1, b.f AS f2, covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0) AS corr
      FROM x a JOIN x b ON a.row = b.row AND a.rank < b.rank GROUP BY 1, 2)
SELECT a.f AS f1, b.f AS f2, pc.corr FROM o a JOIN o b ON a.rank < b.rank LEFT JOIN pc ON pc.f1 = a.f AND pc.f2 = b.f
"""


@register("panel_corr", ops="A8 J12", doubles=["corr"], sql=_panel_corr_sql())
def panel_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every pair of the full target feature block, in one pass."""
    t = _target(spark, sf_dir).where(F.col("target").isNotNull())
    return mx.pairwise_corr(t, PANEL_FEATS)


def _prune_sql() -> str:
    """The fold in list order: each level decides one feature from those kept so far."""
    rank = ", ".join(f"('{f}', {i})" for i, f in enumerate(CORR_FEATS))
    return _corr_sql().replace("WITH", "WITH RECURSIVE", 1).replace("SELECT '", ", corr AS (SELECT '", 1) + f"""),
o AS (SELECT * FROM (VALUES {rank}) v(feature, rank)),
e AS (SELECT f1 AS a, f2 AS b FROM corr WHERE abs(corr) > 0.95 UNION ALL SELECT f2, f1 FROM corr WHERE abs(corr) > 0.95),
x AS (SELECT o.feature, o.rank, list(e.b) FILTER (e.b IS NOT NULL) AS bad FROM o LEFT JOIN e ON e.a = o.feature GROUP BY 1, 2),
f AS (SELECT -1 AS rank, CAST(NULL AS VARCHAR) AS feature, CAST([] AS VARCHAR[]) AS held, false AS kept
      UNION ALL
      SELECT x.rank, x.feature, CASE WHEN list_has_any(f.held, coalesce(x.bad, [])) THEN f.held
             ELSE list_append(f.held, x.feature) END, NOT list_has_any(f.held, coalesce(x.bad, []))
      FROM f JOIN x ON x.rank = f.rank + 1)
SELECT feature, rank, kept FROM f WHERE rank >= 0
"""


@register("greedy_prune", ops="O7 O2", sql=_prune_sql())
def greedy_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prune the correlation candidates in list order at |corr| > 0.95."""
    corr = mx.pairwise_corr(_target(spark, sf_dir), CORR_FEATS)
    order = spark.createDataFrame([(f, i) for i, f in enumerate(CORR_FEATS)], "feature string, rank int")
    return mx.greedy_prune(corr, order, 0.95)
