"""Registered streaming queries (X1-X4). Each runs a Structured Streaming query to completion
(availableNow trigger) over a stream of the given tables and returns the sink table as a batch
DataFrame; the oracle is the batch semantics the stream must reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip
from gridcast.operators import ladder
from gridcast.plans.q_quotes import RAW_QUOTES, SIG_COLS, SIGNALS_SQL
from gridcast.plans.registry import REGISTRY, register
from gridcast.sources import standins as sd
from gridcast.streaming import streams as xs


@register("stream_window_snapshot", ops="X1 A7 (watermark, update mode, foreachBatch upsert log)",
          doubles=["avg_prob", "max_prob"], sql=RAW_QUOTES.replace(
              "CAST(value AS VARCHAR) AS volume_fp\n  FROM events)",
              "CAST(value AS VARCHAR) AS volume_fp, ts\n  FROM events)").join(["WITH ", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, series_ticker, count(*) AS n_open,
       CAST(sum(volume_int) AS BIGINT) AS vol_sum, avg(prob) AS avg_prob, max(prob) AS max_prob
FROM pq WHERE status = 'open' GROUP BY 1, 2
"""]))
def stream_window_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = sd.quote_shape(xs.table_stream(spark, sf_dir, "events"))
    return xs.run_windowed_snapshot(spark, quotes)


@register("stream_signals", ops="X2 G3 J3 (stream-static join)",
          doubles=["threshold_value", "model_prob", "market_implied_prob", "edge"],
          sql=SIGNALS_SQL + f"SELECT {', '.join(SIG_COLS)} FROM sig")
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sd.markets(spark, sf_dir)
    path = xs.land(m, "markets")
    stream = xs.folder_stream(spark, path, m.schema)
    sp = sd.strike_probs(spark, sf_dir).where(F.col("prob") >= 3 / 51.0)
    tr = ladder.monotone(sp, ["row_id"]).select(F.col("row_id").alias("event_id"), "strike_mills",
                                                clip(F.col("fixed_prob"), 0.01, 0.99).alias("prob"))
    return xs.run_stream_scoring(spark, stream, tr, ["event_id", "strike_mills"]).select(*SIG_COLS)


@register("stream_upsert", ops="X3 U2 K9 (foreachBatch, dynamic partition overwrite)",
          doubles=["temp"], sql=None)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = sd.station_daily(spark, sf_dir).withColumn("src", F.lit("cache"))
    o = sd.orders_by_customer_region(spark, sf_dir)
    fresh = (o.where(F.col("o_orderstatus") == "O")
             .groupBy(F.col("c_nationkey").alias("station_id"), F.to_date("o_orderdate").alias("date"))
             .agg((F.avg("o_totalprice") / 4000.0).alias("temp")).withColumn("src", F.lit("fresh")))
    path = xs.land(fresh, "fresh-obs")
    out = xs.run_stream_upsert(spark, cache, xs.folder_stream(spark, path, fresh.schema),
                               ["station_id", "date"])
    return out.select("station_id", "date", "temp", "src")


@register("stream_revisions", ops="X4 W17 J5 (transformWithStateInPandas, timers)",
          doubles=["value", "prev_value", "revision_1d"], sql=None)
def stream_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = sd.forecast_snapshots(spark, sf_dir)
    path = xs.land(snap, "snapshots")
    xs.heartbeat(snap).write.mode("append").parquet(path)
    return xs.run_stream_revisions(spark, xs.folder_stream(spark, path, snap.schema))


# the streaming twins reproduce batch queries: reuse their (already rounded) oracle SQL
REGISTRY["stream_upsert"].sql = REGISTRY["dedupe_upsert"].sql
REGISTRY["stream_revisions"].sql = REGISTRY["forecast_revision"].sql
