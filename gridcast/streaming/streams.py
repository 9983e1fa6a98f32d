"""Structured Streaming variants.

Sinks are exactly-once by construction: ``foreachBatch`` writers tag rows with the batch id
and readers keep the latest batch per key, so a re-executed batch (after a failure) only
rewrites identical rows. Checkpoints and sink folders live under the shared checkpoint dir.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gridcast.operators import gates
from gridcast.operators.quotes import priced_quotes
from gridcast.operators.timeseries import latest_per_key
from gridcast.session import cut_lineage, scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Stream a landed parquet table file (the glob + basePath form lets the file source read a
    single file as well as a folder of arriving files)."""
    base = sf_dir.rstrip("/")
    schema = schema or spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("basePath", base).parquet(f"{base}/{name}.parque[t]")


def folder_stream(spark: SparkSession, path: str, schema: StructType,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def land(df: DataFrame, name: str) -> str:
    """Write a batch DataFrame as a landing folder under the shared checkpoint dir."""
    path = scratch_path(df.sparkSession, f"landing-{name}")
    df.write.mode("overwrite").parquet(path)
    return path


def run_available_now(writer, name: str, spark: SparkSession, checkpoint: str | None = None):
    checkpoint = checkpoint or scratch_path(spark, f"ckpt-{name}")
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# --------------------------------------------------------------------------- X1

def upsert_log_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(path)
    return write


def read_upsert_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(spark.read.parquet(path), list(keys), ["_batch"]).drop("_batch")


def windowed_snapshot(quotes: DataFrame, series: str = "series_ticker", ts: str = "ts",
                      window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Tumbling-window snapshot per series over a quote stream (X1): count, volume sum, mean
    and max probability of open quotes. Test timestamps are TIMESTAMP_NTZ, which watermarks
    reject; the event time is rebuilt as the instant whose UTC wall clock equals the NTZ value
    (from its calendar fields, so the session time zone plays no part) and the window day is
    read back from epoch seconds."""
    c = F.col(ts)
    secs = (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.second(c))
    q = priced_quotes(quotes).where(F.col("status") == "open").withColumn("_et", F.timestamp_seconds(secs))
    g = (q.withWatermark("_et", watermark)
         .groupBy(F.window("_et", window).alias("w"), F.col(series))
         .agg(F.count(F.lit(1)).alias("n_open"), F.sum("volume_int").alias("vol_sum"),
              F.avg("prob").alias("avg_prob"), F.max("prob").alias("max_prob")))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return g.select(day.alias("day"), series, "n_open", "vol_sum", "avg_prob", "max_prob")


def run_windowed_snapshot(spark: SparkSession, quotes: DataFrame, keys=("day", "series_ticker")) -> DataFrame:
    path = scratch_path(spark, "x1-snapshot")
    w = windowed_snapshot(quotes).writeStream.outputMode("update").foreachBatch(upsert_log_writer(path))
    run_available_now(w, "x1", spark)
    return read_upsert_log(spark, path, keys)


# --------------------------------------------------------------------------- X2

def run_stream_scoring(spark: SparkSession, markets_stream: DataFrame, probs: DataFrame,
                       on: list[str]) -> DataFrame:
    """Arriving quotes scored against a static probability table (X2): stream-static left
    join + the G3 gate chain, stateless, appended to a parquet sink."""
    sig = gates.compute_signals(markets_stream, probs, on)
    path = scratch_path(spark, "x2-signals")
    w = sig.writeStream.outputMode("append").format("parquet").option("path", path)
    run_available_now(w, "x2", spark)
    return spark.read.parquet(path)


# --------------------------------------------------------------------------- X3

def upsert_partitions_writer(table: str, keys: Sequence[str], part: str = "year"):
    """foreachBatch merge (X3): the partitions a batch touches are read, merged with the batch
    (batch rows win), materialised (reliable checkpoint, so the overwrite never reads the
    files it replaces) and written back with dynamic partition overwrite."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn(part, F.year("date"))
        years = b.select(part).distinct()
        cur = spark.read.parquet(table).join(F.broadcast(years), part, "left_semi")  # <= years in the batch
        merged = cut_lineage(latest_per_key(
            cur.withColumn("_prio", F.lit(0)).unionByName(b.withColumn("_prio", F.lit(1))),
            list(keys), ["_prio"]).drop("_prio"))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(part).parquet(table))
    return write


def run_stream_upsert(spark: SparkSession, cache: DataFrame, fresh_stream: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    table = scratch_path(spark, "x3-table")
    cache.withColumn("year", F.year("date")).write.partitionBy("year").parquet(table)
    w = fresh_stream.writeStream.foreachBatch(upsert_partitions_writer(table, keys))
    run_available_now(w, "x3", spark)
    return spark.read.parquet(table).drop("year")


# --------------------------------------------------------------------------- X4

REVISION_OUT = ("series_id string, run_ts date, channel string, value double, prev_value double, "
                "revision_1d double")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Revisions(StatefulProcessor):
    """Per-series state of X4: a map (run, channel) -> value of the last closed run and of the open
    ones, and the day of the last closed run. A run stays open, and gathers rows from any number of
    micro-batches, until the watermark passes it; then its timer compares it with the run closed
    before and drops that one, so the state of a series is the open runs and one more. Of repeated
    rows of a channel the greatest value counts, whatever their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "run date, channel string", "value double")
        self.closed = handle.getValueState("closed", "run date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.closed.get()[0] if self.closed.exists() else None
        for pdf in rows:
            for run, channel, value in zip(pdf["run_ts"], pdf["channel"], pdf["value"]):
                if last is not None and run <= last:
                    continue
                value = None if pd.isna(value) else float(value)
                old = self.values.getValue((run, channel)) if self.values.containsKey((run, channel)) else None
                if old is None or old[0] is None or (value is not None and value > old[0]):
                    self.values.updateValue((run, channel), (value,))
                self.handle.registerTimer(_closes(run))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last = self.closed.get()[0] if self.closed.exists() else None
        runs: dict = {}
        for (run, channel), (value,) in list(self.values.iterator()):
            runs.setdefault(run, {})[channel] = value
        rows = []
        for run in sorted(r for r in runs if (last is None or r > last) and _closes(r) <= now):
            before = runs.get(last, {})
            for channel, value in sorted(runs[run].items(), key=lambda x: (x[0] is not None, x[0])):
                prev = before.get(channel)
                rows.append((key[0], run, channel, value, prev, None if value is None or prev is None else value - prev))
            for channel in before:
                self.values.removeKey((last, channel))
            self.closed.update((run,))
            last = run
        yield pd.DataFrame(rows, columns=["series_id", "run_ts", "channel", "value", "prev_value", "revision_1d"])

    def close(self) -> None:
        pass


def _closes(run) -> int:
    """Milliseconds since the epoch at which the watermark closes a run: just past its day's start."""
    return (run - dt.date(1970, 1, 1)).days * 86_400_000 + 1


def heartbeat(snapshots: DataFrame, delay_days: int = 1) -> DataFrame:
    """One row that ends a replay: a run late enough for the watermark to close all others. Its own
    series (the empty one) is never closed, so it has no output. Live feeds need none, their next
    runs move the watermark."""
    names = {"series_id": F.lit(""), "version": F.lit(1), "run_ts": F.date_add(F.max("run_ts"), delay_days + 2)}
    kept = [c for c in snapshots.columns if c in names]
    one = snapshots.agg(*[names[c].alias(c) for c in kept]).where(F.col("run_ts").isNotNull())
    return one.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in snapshots.schema])


def run_stream_revisions(spark: SparkSession, snapshots_stream: DataFrame, delay_days: int = 1,
                         path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Forecast revisions as a keyed stateful stream (X4): map state on RocksDB, event-time timers
    close a run ``delay_days`` behind the newest. ``path`` and ``checkpoint`` name a sink and a
    checkpoint folder to go on with; left out, they are new."""
    s = snapshots_stream.where(F.col("version") == 1).select(
        "series_id", "run_ts", "channel", "value", F.timestamp_seconds(F.unix_date("run_ts").cast("long") * 86400).alias("_et"))
    out = s.withWatermark("_et", f"{delay_days} days").groupBy("series_id").transformWithStateInPandas(
        Revisions(), REVISION_OUT, "append", "EventTime")
    path = path or scratch_path(spark, "x4-revisions")
    w = out.writeStream.outputMode("append").format("parquet").option("path", path)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run_available_now(w, "x4", spark, checkpoint)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(REVISION_OUT).parquet(path)
