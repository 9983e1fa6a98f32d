"""Sinks (K1-K10). Data stays typed in Parquet; text formatting happens only here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.gates import reason_text


def write_signals_csv(signals: DataFrame, path: str) -> None:
    """Signals with a formatted reason as CSV with header (K1)."""
    out = signals.withColumn("decision_reason", reason_text(signals))
    out.write.mode("overwrite").option("header", True).csv(path)


def run_report(signals: DataFrame, probs: DataFrame, meta: DataFrame, group: Sequence[str]) -> DataFrame:
    """One JSON-ready row per group (K2, F14): metadata, the strike -> probability map with
    3-decimal keys, and the signal records. The collected lists are one ladder per group
    (bounded by the listed strikes), which is the document being produced."""
    pm = probs.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(
        F.format_string("%.3f", F.col("strike")), F.col("prob")))).alias("threshold_probabilities"))
    sg = signals.groupBy(*group).agg(F.collect_list(F.struct(*[F.col(c) for c in signals.columns
                                                               if c not in group])).alias("signals"))
    return meta.join(pm, list(group), "left").join(sg, list(group), "left")


def write_run_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_importance_audit(summary: DataFrame, path: str) -> None:
    """Feature-importance audit sorted by importance (K3); one file, the table has one row per
    candidate feature."""
    (summary.orderBy(F.col("mean_importance").desc(), "feature").coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))


def write_holdout_dump(pairs: DataFrame, path: str) -> None:
    """(probability, label, strike) holdout pairs (K4): typed Parquet plus a formatted CSV."""
    pairs.write.mode("overwrite").parquet(f"{path}/parquet")
    pairs.select(F.format_string("%.6f", "prob").alias("prob"), F.col("label").cast("int").alias("label"),
                 F.format_string("%.3f", "strike").alias("strike")) \
        .write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def append_trades(trades: DataFrame, path: str) -> None:
    """Trades are append-only (K5)."""
    trades.write.mode("append").parquet(path)


def _missing(exc: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc)


def latest_version(spark: SparkSession, base: str) -> int | None:
    """The greatest committed version under ``base`` (K5), None where nothing was committed."""
    try:
        commits = spark.read.schema("version long").parquet(f"{base.rstrip('/')}/commits")
    except AnalysisException as exc:
        if _missing(exc):
            return None
        raise
    return commits.agg(F.max("version")).first()[0]


def _version_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={version:08d}"


def write_positions_version(positions: DataFrame, base: str, version: int, commit: bool = True) -> str:
    """Positions are rewritten as a new immutable version folder (K5). The commit is a row written
    last, so a cycle that fails before leaves a folder that no reader takes; writing that version
    again replaces it. A committed version is never overwritten."""
    spark = positions.sparkSession
    held = latest_version(spark, base)
    if held is not None and version <= held:
        raise ValueError(f"version {version} of {base} is not after the committed {held}")
    path = _version_path(base, version)
    positions.write.mode("overwrite").parquet(path)
    if commit:
        spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/commits")
    return path


def read_positions_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    """The latest committed version (K5), or the committed one asked for; None before the first."""
    held = latest_version(spark, base)
    if held is None or (version is not None and version > held):
        return None
    return spark.read.parquet(_version_path(base, held if version is None else version))


def model_snapshot(forecast: Column, sigma: Column) -> list[Column]:
    """q05 / q50 / q95 = forecast -+ 1.645 sigma."""
    return [(forecast - 1.645 * sigma).alias("quantile_05"), forecast.alias("quantile_50"),
            (forecast + 1.645 * sigma).alias("quantile_95")]


def append_model_snapshot(row: DataFrame, path: str) -> None:
    """Append one snapshot row per run (K6). Columns may be new; the reader merges the schemas."""
    row.write.mode("append").parquet(path)


def read_model_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """All snapshot rows with the columns of any of them, null where a run had none (K6): the schemas
    of the files are merged on reading instead of ALTER TABLE. None before the first snapshot."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as exc:
        if _missing(exc):
            return None
        raise


def write_market_views(views: DataFrame, path: str, capture_date: Column) -> None:
    """Market views partitioned by capture date (K7)."""
    views.withColumn("capture_date", capture_date).write.mode("append").partitionBy("capture_date").parquet(path)


def save_current_forecast(wide: DataFrame, keys: Sequence[str], run_ts: Column, path: str) -> DataFrame:
    """Persist the current forecast as long numeric rows (K8, P4): unpivot wide -> long, drop
    NULL / NaN, stamp run and version, append."""
    vals = [c for c, t in wide.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    long = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        list(keys), vals, "channel", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
        "run_ts", run_ts).withColumn("version", F.lit(1))
    long.write.mode("append").parquet(path)
    return long


def upsert_station_cache(table: str, fresh: DataFrame, keys: Sequence[str] = ("station_id", "date")) -> None:
    """Incremental station cache (K9): merge ``fresh`` into the year-partitioned table at
    ``table`` (fresh rows win per key) and rewrite only the touched year partitions (dynamic
    partition overwrite). Same merge as the streaming variant (X3)."""
    from gridcast.streaming.streams import upsert_partitions_writer
    upsert_partitions_writer(table, keys)(fresh, 0)


def refresh_station_cache(table: str, landed: DataFrame, years: DataFrame, keys: Sequence[str] = ("station_id", "date"),
                          year: str = "year") -> None:
    """Incremental refresh (U3, K9): of ``landed``, a table partitioned by year, only the partitions in
    ``years`` are read (dynamic partition pruning by the broadcast list, a row a year), and only those
    partitions of the cache are read and rewritten."""
    fresh = landed.join(F.broadcast(years.select(year)), year, "left_semi").drop(year)
    upsert_station_cache(table, fresh, keys)
