"""Registered queries: window features on the gap-free daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import calendar_columns
from gridcast.operators import timeseries as ts
from gridcast.plans import sqlparts as S
from gridcast.plans.q_timeseries import K, panel_spine
from gridcast.plans.registry import register
from gridcast.sources import standins as sd
from gridcast.sources.calendars import holidays_df

W = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"


def _roll(fn: str, col: str, n: int, mp: int, shift: int = 1, alias: str = "") -> str:
    hi = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    lo = n + shift - 1
    fr = f"(w ROWS BETWEEN {lo} PRECEDING AND {hi})"
    return f"CASE WHEN count({col}) OVER {fr} >= {mp} THEN {fn}({col}) OVER {fr} END AS {alias}"


# --------------------------------------------------------------------------- W1 / W5 / W6

LAGS = (1, 2, 3, 7, 14)
LAG_COLS = [f"{p}_lag_{n}" for p in ("hdd", "cdd") for n in LAGS] + ["temp_lag_1", "temp_lag_7"]


@register("lag_block", ops="W1 W5 W6", doubles=LAG_COLS, sql=f"""
WITH {S.PANEL}
SELECT series_id, date,
  {", ".join(f"lag({p}, {n}) OVER w AS {p}_lag_{n}" for p in ("hdd", "cdd") for n in LAGS)},
  lag(temp, 1) OVER w AS temp_lag_1, lag(temp, 7) OVER w AS temp_lag_7
FROM panel {W}
""")
def lag_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_spine(spark, sf_dir)
    cols = [ts.lag(c, n, K).alias(f"{c}_lag_{n}") for c in ("hdd", "cdd") for n in LAGS]
    cols += [ts.lag("temp", 1, K).alias("temp_lag_1"), ts.lag("temp", 7, K).alias("temp_lag_7")]
    return p.select(*K, "date", *cols)


# --------------------------------------------------------------------------- W2 / W7 / W8

ROLL = [("hdd", 7, 3), ("hdd", 30, 10), ("cdd", 7, 3), ("cdd", 30, 10), ("temp", 3, 1)]


@register("rolling_mean_min_periods", ops="W2 W5 W7 W8",
          doubles=[f"{c}_rolling_{n}" for c, n, _ in ROLL], sql=f"""
WITH {S.PANEL}
SELECT series_id, date, {", ".join(_roll("avg", c, n, mp, alias=f"{c}_rolling_{n}") for c, n, mp in ROLL)}
FROM panel {W}
""")
def rolling_mean_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_spine(spark, sf_dir)
    return p.select(*K, "date", *[ts.rolling(F.col(c), n, mp, "mean", K).alias(f"{c}_rolling_{n}")
                                  for c, n, mp in ROLL])


# --------------------------------------------------------------------------- W3 / W7

@register("rolling_sum", ops="W3 W7 W8", doubles=["hdd_sum_3d", "cdd_sum_3d"], sql=f"""
WITH {S.PANEL},
f AS (SELECT *, CASE WHEN temp IS NOT NULL THEN CAST(temp > 70.0 AS INTEGER) END AS storm FROM panel)
SELECT series_id, date, {_roll("sum", "hdd", 3, 2, alias="hdd_sum_3d")},
  {_roll("sum", "cdd", 3, 2, alias="cdd_sum_3d")},
  CAST(CASE WHEN count(storm) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 1
       THEN sum(storm) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS BIGINT) AS storm_count_7d
FROM f {W}
""")
def rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_spine(spark, sf_dir)
    p = p.withColumn("storm", F.when(F.col("temp").isNotNull(), (F.col("temp") > 70.0).cast("int")))
    return p.select(*K, "date",
                    ts.rolling(F.col("hdd"), 3, 2, "sum", K).alias("hdd_sum_3d"),
                    ts.rolling(F.col("cdd"), 3, 2, "sum", K).alias("cdd_sum_3d"),
                    ts.rolling(F.col("storm"), 7, 1, "sum", K).cast("bigint").alias("storm_count_7d"))


# --------------------------------------------------------------------------- W4

@register("streaks", ops="W4", doubles=["cold_wave_days", "heat_wave_days"], sql=f"""
WITH {S.PANEL},
f AS (SELECT series_id, date, row_number() OVER w AS rn,
             coalesce(lag(hdd, 1) OVER w > 25.0, false) AS fc,
             coalesce(lag(cdd, 1) OVER w > 15.0, false) AS fh
      FROM panel {W})
SELECT series_id, date,
  CAST(rn - coalesce(max(CASE WHEN NOT fc THEN rn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS DOUBLE) AS cold_wave_days,
  CAST(rn - coalesce(max(CASE WHEN NOT fh THEN rn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS DOUBLE) AS heat_wave_days
FROM f {W}
""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_spine(spark, sf_dir)
    out = ts.streak_columns(p, [("hdd", 25.0, "cold_wave_days"), ("cdd", 15.0, "heat_wave_days")], K)
    return out.select(*K, "date", "cold_wave_days", "heat_wave_days")


# --------------------------------------------------------------------------- W9 / W10

WOW = ["storage", "storage_lag_7", "storage_lag_14", "storage_change_wow", "production",
       "production_lag_30", "production_lag_365", "production_yoy"]


@register("wow_yoy_change", ops="W9 W10 S3 S4", doubles=WOW, sql=f"""
WITH {S.periodic('week', 'wk')}, {S.ffill_spine('wk', 'wf', 10)},
     {S.periodic('month', 'mo')}, {S.ffill_spine('mo', 'mf', 40)},
a AS (SELECT series_id, date, value AS storage, lag(value, 7) OVER w AS storage_lag_7,
             lag(value, 14) OVER w AS storage_lag_14,
             lag(value, 7) OVER w - lag(value, 14) OVER w AS storage_change_wow
      FROM wf {W}),
b AS (SELECT series_id, date, value AS production, lag(value, 30) OVER w AS production_lag_30,
             lag(value, 365) OVER w AS production_lag_365,
             value - lag(value, 365) OVER w AS production_yoy
      FROM mf {W})
SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.date, b.date) AS date,
       a.storage, a.storage_lag_7, a.storage_lag_14, a.storage_change_wow,
       b.production, b.production_lag_30, b.production_lag_365, b.production_yoy
FROM a FULL OUTER JOIN b ON a.series_id = b.series_id AND a.date = b.date
""")
def wow_yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    wk = ts.gap_free_spine(sd.periodic_feed(spark, sf_dir, "week"), K, ["value"], tail_days=10, fill=True)
    mo = ts.gap_free_spine(sd.periodic_feed(spark, sf_dir, "month"), K, ["value"], tail_days=40, fill=True)
    a = wk.select(*K, "date", F.col("value").alias("storage"),
                  ts.lag("value", 7, K).alias("storage_lag_7"),
                  ts.lag("value", 14, K).alias("storage_lag_14"),
                  (ts.lag("value", 7, K) - ts.lag("value", 14, K)).alias("storage_change_wow"))
    b = mo.select(*K, "date", F.col("value").alias("production"),
                  ts.lag("value", 30, K).alias("production_lag_30"),
                  ts.lag("value", 365, K).alias("production_lag_365"),
                  (F.col("value") - ts.lag("value", 365, K)).alias("production_yoy"))
    return ts.outer_join_all([a, b], [*K, "date"])


# --------------------------------------------------------------------------- W11-W16

TLAGS = (1, 2, 3, 5, 7, 14, 30, 60, 90)
TREND = ["target_rolling_7", "target_rolling_30", "target_rolling_90", "target_rolling_30_std",
         "target_rolling_90_std", "trend_dev_30", "trend_dev_90", "trend_sma7_minus_sma30",
         "trend_sma30_minus_sma90"]
ROC = ["roc_7", "roc_30", "roc_90"]
LOGR = ["log_return_lag_1", "log_return_lag_2", "log_return_lag_7", "log_return_abs_rolling_7",
        "log_return_std_14", "log_return_std_30", "log_return_std_90",
        "log_return_vol_30_minus_90", "log_return_accel"]

TARGET_SQL = f"""
WITH {S.PANEL},
a AS (
  SELECT series_id, date, target,
    {", ".join(f"lag(target, {n}) OVER w AS target_lag_{n}" for n in TLAGS)},
    {_roll("avg", "target", 7, 3, alias="s7")}, {_roll("avg", "target", 30, 10, alias="s30")},
    {_roll("avg", "target", 90, 30, alias="s90")},
    {_roll("stddev_samp", "target", 30, 10, alias="target_rolling_30_std")},
    {_roll("stddev_samp", "target", 90, 30, alias="target_rolling_90_std")},
    {", ".join(f"lag(target, 1) OVER w / nullif(lag(target, {n + 1}) OVER w, 0) - 1.0 AS roc_{n}" for n in (7, 30, 90))},
    CASE WHEN target > 0 THEN ln(target) END
      - lag(CASE WHEN target > 0 THEN ln(target) END, 1) OVER w AS lr
  FROM panel {W}),
b AS (SELECT *, lag(lr, 1) OVER w AS x FROM a {W}),
c AS (
  SELECT *, s7 AS target_rolling_7, s30 AS target_rolling_30, s90 AS target_rolling_90,
    target_lag_1 - s30 AS trend_dev_30, target_lag_1 - s90 AS trend_dev_90,
    s7 - s30 AS trend_sma7_minus_sma30, s30 - s90 AS trend_sma30_minus_sma90,
    x AS log_return_lag_1, lag(x, 1) OVER w AS log_return_lag_2, lag(x, 6) OVER w AS log_return_lag_7,
    CASE WHEN count(x) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 3
         THEN avg(abs(x)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS log_return_abs_rolling_7,
    {_roll("stddev_samp", "x", 14, 5, 0, "log_return_std_14")},
    {_roll("stddev_samp", "x", 30, 10, 0, "log_return_std_30")},
    {_roll("stddev_samp", "x", 90, 30, 0, "log_return_std_90")},
    x - lag(x, 7) OVER w AS log_return_accel
  FROM b {W}),
t AS (SELECT *, log_return_std_30 - log_return_std_90 AS log_return_vol_30_minus_90 FROM c)
"""


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.target_features(panel_spine(spark, sf_dir), K)


@register("target_lags", ops="W11", doubles=["target"] + [f"target_lag_{n}" for n in TLAGS],
          sql=TARGET_SQL + f"SELECT series_id, date, target, {', '.join(f'target_lag_{n}' for n in TLAGS)} FROM t")
def target_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).select(*K, "date", "target", *[f"target_lag_{n}" for n in TLAGS])


@register("trend_sma", ops="W12 W13", doubles=TREND,
          sql=TARGET_SQL + f"SELECT series_id, date, {', '.join(TREND)} FROM t")
def trend_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).select(*K, "date", *TREND)


@register("rate_of_change", ops="W13", doubles=ROC,
          sql=TARGET_SQL + f"SELECT series_id, date, {', '.join(ROC)} FROM t")
def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).select(*K, "date", *ROC)


@register("log_return_vol", ops="W14 W15 W16 F10", doubles=LOGR,
          sql=TARGET_SQL + f"SELECT series_id, date, {', '.join(LOGR)} FROM t")
def log_return_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).select(*K, "date", *LOGR)


FLAG_COLS = ["target"] + [f"target_lag_{n}" for n in TLAGS] + TREND + ROC + LOGR


@register("feature_panel", ops="flagship: S1 J1 T1 W11-W16 P2 P8", doubles=FLAG_COLS,
          sql=TARGET_SQL + f"SELECT series_id, date, {', '.join(FLAG_COLS)} FROM t WHERE target IS NOT NULL")
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the target feature block with null-target rows dropped after the windows
    (P2: lags see the null rows)."""
    return _target(spark, sf_dir).where(F.col("target").isNotNull()).select(*K, "date", *FLAG_COLS)


# --------------------------------------------------------------------------- F7 / F8 / F9 / J11

CAL = ["dow_sin", "dow_cos", "month_sin", "month_cos"]


@register("calendar_features", ops="F7 F8", doubles=CAL, sql=f"""
WITH {S.PANEL}
SELECT series_id, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend, CAST(isodow(date) - 1 = 3 AS INTEGER) AS is_thursday,
  CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(month(date) IN (12, 1, 2) AS INTEGER) AS is_winter, CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer,
  CAST(month(date) IN (3, 4, 5, 9, 10, 11) AS INTEGER) AS is_shoulder,
  sin(2 * pi() * (isodow(date) - 1) / 7.0) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7.0) AS dow_cos,
  sin(2 * pi() * month(date) / 12.0) AS month_sin, cos(2 * pi() * month(date) / 12.0) AS month_cos
FROM panel
""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_spine(spark, sf_dir)
    return p.select(*K, "date", *calendar_columns("date"))


def _holiday_sql() -> str:
    from gridcast.sources.calendars import US_FEDERAL_HOLIDAYS
    vals = ", ".join(f"(DATE '{d}')" for d in US_FEDERAL_HOLIDAYS)
    return f"hol(h) AS (VALUES {vals})"


@register("holiday_flag", ops="F9 J11", sql=f"""
WITH {_holiday_sql()},
d AS (SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS date FROM events)
SELECT series_id, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM hol WHERE hol.h = d.date) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday
FROM d
""")
def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sd.table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"),
                                                 F.to_date("ts").alias("date")).distinct()
    out = ts.holiday_flag(e, holidays_df(spark))
    return out.select(*K, "date", F.weekday("date").alias("day_of_week"), "is_holiday")


# --------------------------------------------------------------------------- W17 / J5 / S10

@register("forecast_revision", ops="W17 J5 S10 K8", doubles=["value", "prev_value", "revision_1d"], sql="""
WITH s AS (
  SELECT r.r_name AS series_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS run_ts,
         o.o_orderpriority AS channel, avg(o.o_totalprice) / 1000.0 AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderstatus <> 'P' GROUP BY 1, 2, 3),
runs AS (SELECT series_id, run_ts, dense_rank() OVER (PARTITION BY series_id ORDER BY run_ts) AS rk
         FROM (SELECT DISTINCT series_id, run_ts FROM s)),
cur AS (SELECT s.*, runs.rk FROM s JOIN runs USING (series_id, run_ts))
SELECT c.series_id, c.run_ts, c.channel, c.value, p.value AS prev_value, c.value - p.value AS revision_1d
FROM cur c LEFT JOIN cur p ON c.series_id = p.series_id AND c.channel = p.channel AND p.rk = c.rk - 1
""")
def forecast_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = sd.forecast_snapshots(spark, sf_dir)
    return ts.forecast_revisions(snap, K)
