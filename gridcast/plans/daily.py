"""Daily scoring (entry 2 of the reference job) as one plan over all series:

today feature row (P14) -> point forecast (M10) -> dynamic grid (L4) around it with the
residual spread (A13) -> strike classifier scored once per trained strike (L3) -> monotone
ladder (L1) -> interpolated at grid and market strikes (L2) -> signals (G1-G3).

Models come from ``learn`` (fit once, scored here); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import strike_mills
from gridcast.learn.models import prob_of_one
from gridcast.operators import gates, ladder
from gridcast.operators import timeseries as ts


@dataclass
class DailyScore:
    features: DataFrame
    forecast: DataFrame
    grid_probs: DataFrame
    signals: DataFrame


def today_feature_rows(history: DataFrame, today: DataFrame, keys: Sequence[str],
                       target: str = "target", date: str = "date",
                       carry_static: Sequence[str] = ()) -> DataFrame:
    """History + today rows (existing rows of those dates replaced) -> gap-free spine ->
    target and calendar features -> only the today rows (P14). Columns the today row lacks are
    NULL, as in the reference (D19); ``carry_static`` names columns that instead keep their
    last known history value on the today row."""
    from pyspark.sql import Window
    keys = list(keys)
    h = history.join(today.select(*keys, date), [*keys, date], "left_anti").withColumn("_today", F.lit(0))
    u = h.unionByName(today.withColumn("_today", F.lit(1)), allowMissingColumns=True)
    vals = [c for c in u.columns if c not in (*keys, date)]
    sp = ts.gap_free_spine(u, keys, vals, date=date)
    if carry_static:
        w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        for c in carry_static:
            sp = sp.withColumn(c, F.when(F.col("_today") == 1, F.last(c, ignorenulls=True).over(w))
                               .otherwise(F.col(c)))
    f = ts.target_features(sp, keys, target=target, date=date)
    f = f.withColumn("day_of_week", F.weekday(date).cast("double")).withColumn("month", F.month(date).cast("double"))
    return f.where(F.col("_today") == 1).drop("_today")


def score_day(history: DataFrame, today: DataFrame, markets: DataFrame, point_model, strike_model,
              trained_strikes: DataFrame, residual_std: DataFrame, keys: Sequence[str] = ("series_id",),
              grid_step: float = 0.05, signal_cfg: gates.SignalCfg = gates.SignalCfg()) -> DailyScore:
    """``markets`` carry the series keys plus the market columns of ``gates.compute_signals``;
    ``trained_strikes``: (keys, strike); ``residual_std``: (keys, residual_std)."""
    keys = list(keys)
    rows = today_feature_rows(history, today, keys)
    fc = point_model.transform(rows).select(*keys, "date", F.col("prediction").alias("forecast"))
    centers = fc.join(residual_std, keys).withColumnRenamed("residual_std", "sigma")
    grid = ladder.dynamic_grid(centers, keys, step=grid_step)
    x = rows.join(trained_strikes, keys).withColumn("strike_gap", F.col("strike") - F.col("target_lag_1"))
    p = prob_of_one(strike_model.transform(x)).select(*keys, strike_mills("strike").alias("strike_mills"), "prob")
    fixed = ladder.monotone(p, keys).withColumn("strike", F.col("strike_mills") / 1000.0)
    gp = ladder.interpolate(fixed, grid.select(*keys, "i", "strike"), keys)
    wanted = markets.select(*keys, "ticker", F.col("threshold_value").alias("strike"))
    mp = ladder.interpolate(fixed, wanted, keys).select(*keys, "ticker", "prob")
    sig = gates.compute_signals(markets, mp, [*keys, "ticker"], signal_cfg)
    return DailyScore(rows, fc, gp, sig)
