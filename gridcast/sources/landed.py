"""Readers for landed feeds (S1-S10). Input is files already landed by an ingest job (JSON
pages, parquet tables); HTTP, paging loops and retries are not part of the library.

Every reader declares its schema (no inference pass over the data), coerces with ``try_cast``
so a bad record becomes NULL instead of failing the job, and leaves filters to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from gridcast.functions.scalar import epoch_day, iso_text_day, num
from gridcast.operators.timeseries import latest_per_key

SERIES_PAGE = StructType([
    StructField("series_id", StringType()),
    StructField("page", LongType()),
    StructField("response", StructType([StructField("data", ArrayType(StructType([
        StructField("period", StringType()), StructField("value", StringType())])))])),
])

FORECAST_PAYLOAD = StructType([
    StructField("station", StringType()),
    StructField("alerts", ArrayType(StructType([StructField("event", StringType())]))),
    StructField("daily", ArrayType(StructType([
        StructField("dt", LongType()),
        StructField("temp", StructType([StructField("day", DoubleType())])),
        StructField("wind_speed", DoubleType()),
        StructField("humidity", DoubleType())]))),
])

QUOTE = StructType([StructField(c, StringType()) for c in (
    "series_ticker", "ticker", "status", "yes_ask", "yes_ask_dollars", "last_price_dollars",
    "yes_bid_dollars", "volume", "volume_fp")] + [StructField("ts", StringType())])


def period_day(x: Column) -> Column:
    """'yyyy-MM-dd...' or monthly 'yyyy-MM' (first of month) -> DATE."""
    return F.coalesce(iso_text_day(x), F.try_to_date(x, "yyyy-MM"))


def read_series_pages(spark: SparkSession, path: str) -> DataFrame:
    """Series feed pages -> typed (series_id, date, value).

    Each landed page holds ``response.data[]``; pages of a series are unioned by the file
    scan (no offset loop), periods parsed (daily or monthly), values coerced (bad -> NULL),
    and a period present on several pages keeps the row of the latest page.
    """
    raw = spark.read.schema(SERIES_PAGE).json(path)
    rows = raw.select("series_id", "page", F.explode("response.data").alias("r"))
    typed = rows.select("series_id", period_day(F.col("r.period")).alias("date"),
                        num(F.col("r.value")).alias("value"), "page").where(F.col("date").isNotNull())
    return latest_per_key(typed, ["series_id", "date"], ["page"]).drop("page")


def explode_forecast_payload(payload: DataFrame, days_ahead: int) -> DataFrame:
    """Nested forecast payload -> one row per (station, day) for the first N days (S6):
    epoch seconds -> UTC date, alerts present -> flag."""
    d = payload.select("station", (F.size(F.coalesce("alerts", F.array())) > 0).cast("int").alias("alert"),
                       F.posexplode(F.slice(F.coalesce("daily", F.array()), 1, days_ahead)).alias("k", "d"))
    return d.select(F.col("station").alias("station_id"), epoch_day(F.col("d.dt")).alias("date"),
                    F.col("d.temp.day").alias("temp"), F.col("d.wind_speed").alias("wind"),
                    F.col("d.humidity").alias("humidity"), "alert", F.col("k").alias("day_index"))


def read_forecast_payload(spark: SparkSession, path: str, days_ahead: int = 2) -> DataFrame:
    return explode_forecast_payload(spark.read.schema(FORECAST_PAYLOAD).json(path), days_ahead)


def read_quotes(spark: SparkSession, path: str, series_dim: DataFrame | None = None,
                ticker_prefix: str | None = None, status: str = "open") -> DataFrame:
    """Open-market quotes (S7, S8): status filter pushed to the scan, restricted to a series
    dimension (left-semi, broadcast dimension) or a ticker prefix. No per-series cap."""
    q = spark.read.schema(QUOTE).json(path).where(F.col("status") == status)
    if series_dim is not None:
        q = q.join(F.broadcast(series_dim.select("series_ticker")), "series_ticker", "left_semi")
    if ticker_prefix is not None:
        q = q.where(F.col("ticker").startswith(ticker_prefix))
    return q


def latest_market_status(status: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Latest status per ticker for all tickers at once."""
    return latest_per_key(status, ["ticker"], list(order))


def previous_forecast(snapshots: DataFrame, as_of: Column, keys: Sequence[str] = ("series_id",),
                      version: int = 1) -> DataFrame:
    """Latest version-matching run strictly before ``as_of`` per key, long form.
    A key without one yields no rows, so a later left join gives NULL deltas."""
    s = snapshots.where((F.col("version") == version) & (F.col("run_ts") < as_of))
    last = s.groupBy(*keys).agg(F.max("run_ts").alias("_last"))
    return s.join(last, list(keys)).where(F.col("run_ts") == F.col("_last")).drop("_last")
