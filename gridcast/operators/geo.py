"""Weighted scopes over stations.

Stations join a small dimension (weight, region). National and regional aggregates come out
of one ``groupingSets`` aggregation: one shuffle for all scopes, with partial aggregation so a
station or date holding a large share of rows is reduced map-side before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("TAVG", "TMAX", "TMIN")


def pivot_metrics(long: DataFrame, keys: Sequence[str], datatypes: Sequence[str] = METRICS,
                  datatype: str = "datatype", value: str = "value") -> DataFrame:
    """Long station feed -> one column per metric (S5, P4). Listing the pivot values keeps the
    columns present even when a metric never occurs, and skips Spark's distinct-value pass."""
    wide = (long.where(F.col(datatype).isin(*datatypes))
            .groupBy(*keys).pivot(datatype, list(datatypes)).agg(F.max(value)))
    return wide.select(*keys, *[F.col(d).alias(d.lower()) for d in datatypes])


def midpoint_fallback(avg: str = "tavg", hi: str = "tmax", lo: str = "tmin") -> Column:
    """Daily average, else the mid of max and min (A4)."""
    return F.coalesce(F.col(avg), (F.col(hi) + F.col(lo)) / 2.0)


def _wmean(x: Column, w: Column) -> Column:
    """Null-aware weighted mean: weights renormalised over the stations that report x (A1)."""
    return F.try_divide(F.sum(F.when(x.isNotNull(), x * w)), F.sum(F.when(x.isNotNull(), w)))


def _scoped(obs: DataFrame, dim: DataFrame, station: str, date: str):
    j = obs.join(dim, station)  # inner: only known stations are kept (J10)
    return j.groupingSets([["region", date], [date]], "region", date)


def _scope_col(national: str) -> Column:
    return F.coalesce(F.col("region"), F.lit(national)).alias("scope")


def scope_weighted_mean(obs: DataFrame, dim: DataFrame, metrics: Sequence[str],
                        station: str = "station_id", date: str = "date",
                        national: str = "national") -> DataFrame:
    """Weighted mean per (scope, date) for national and every region at once (A1, A2)."""
    w = F.col("weight")
    aggs = [_wmean(F.col(m), w).alias(m) for m in metrics]
    first = F.col(metrics[0])
    aggs.append(F.sum(F.when(first.isNotNull(), w)).alias("weight_used"))
    g = _scoped(obs, dim, station, date).agg(*aggs)
    return g.select(_scope_col(national), date, *metrics, "weight_used")


def forecast_scope_aggregate(obs: DataFrame, dim: DataFrame, station: str = "station_id",
                             date: str = "date", national: str = "national",
                             storm_wind: float = 35.0, gulf_wind: float = 40.0,
                             denominator: str = "reporting") -> DataFrame:
    """Forecast aggregate per (scope, date) (A5, A6): weighted temp / wind / humidity (each
    renormalised over the stations reporting it), max wind, storm flag (any wind above 35 or an
    alert), Gulf-style flag (max wind above 40 or an alert) and the weight of stations used.
    ``denominator="all"`` divides every metric by the weight of all stations present that day
    (the reference's accumulator, which also counts a station whose metric is missing)."""
    w = F.col("weight")
    if denominator == "all":
        def mean(x):
            return F.try_divide(F.coalesce(F.sum(F.when(x.isNotNull(), x * w)), F.lit(0.0)), F.sum(w))
    else:
        def mean(x):
            return _wmean(x, w)
    g = _scoped(obs, dim, station, date).agg(
        mean(F.col("temp")).alias("temp"),
        mean(F.col("wind")).alias("wind"),
        mean(F.col("humidity")).alias("humidity"),
        F.max("wind").alias("max_wind"),
        F.greatest(F.max(F.when(F.col("wind") > storm_wind, 1).otherwise(0)),
                   F.max("alert")).cast("int").alias("storm_flag"),
        F.when((F.max("wind") > gulf_wind) | (F.max("alert") == 1), 1).otherwise(0)
        .cast("int").alias("gulf_flag"),
        F.sum(w).alias("weight_used"),
    )
    return g.select(_scope_col(national), date, "temp", "wind", "humidity", "max_wind",
                    "storm_flag", "gulf_flag", "weight_used")
