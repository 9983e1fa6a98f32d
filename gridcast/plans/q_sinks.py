"""Registered queries of the sinks and of what is read back from them (K1, K2, K4, K8, S10, S12, K10),
the snapshot attach (P12) and the ensemble blend (A19). Every file is derived from the given tables,
so its size grows with them; the oracle is the same data computed directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.learn import elastic_path
from gridcast.learn import models as ml
from gridcast.operators import timeseries as ts
from gridcast.plans import sqlparts as S
from gridcast.plans.q_features import TARGET_SQL, _target
from gridcast.plans.q_learn import ML_FEATS, ml_frame
from gridcast.plans.q_metrics import PRED_SQL
from gridcast.plans.q_quotes import SIGNALS_SQL, signal_table
from gridcast.plans.q_timeseries import K
from gridcast.plans.registry import register
from gridcast.session import scratch_path
from gridcast.sinks import writers
from gridcast.sources import landed
from gridcast.sources import standins as sd

# fixed values: gate limits that the reason texts quote
LIMITS = {"volume": 25, "interest": 25, "spread": 10, "entry": 75}


@register("signals_csv", ops="K1 F13", doubles=["threshold_value", "edge"], sql=SIGNALS_SQL + f"""
SELECT event_id, ticker, threshold_value, edge, decision, reason_code,
  CASE reason_code
    WHEN 'volume_too_low' THEN printf('volume_too_low (%d<{LIMITS["volume"]})', volume)
    WHEN 'open_interest_too_low' THEN printf('open_interest_too_low (%d<{LIMITS["interest"]})', open_interest)
    WHEN 'spread_too_wide' THEN printf('spread_too_wide (%dc>{LIMITS["spread"]}c)', spread_cents)
    WHEN 'entry_too_expensive_yes' THEN printf('entry_too_expensive_yes (%dc>{LIMITS["entry"]}c)', yes_ask_cents)
    WHEN 'entry_too_expensive_no' THEN printf('entry_too_expensive_no (%dc>{LIMITS["entry"]}c)', no_ask_cents)
    WHEN 'edge_yes' THEN printf('edge_yes=%+.3f', edge) WHEN 'edge_no' THEN printf('edge_no=%+.3f', edge)
    WHEN 'insufficient_edge' THEN printf('insufficient_edge (%+.3f)', edge) ELSE reason_code END AS decision_reason
FROM sig
""")
def signals_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as CSV with their formatted reason and read back."""
    path, table = scratch_path(spark, "signals-csv"), signal_table(spark, sf_dir)
    writers.write_signals_csv(table, path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    back = spark.read.schema(f"{kinds}, decision_reason string").option("header", True).csv(path)
    return back.select("event_id", "ticker", "threshold_value", "edge", "decision", "reason_code", "decision_reason")


@register("run_report_json", ops="K2 F14", doubles=["top_prob"], sql=SIGNALS_SQL + """,
t AS (SELECT row_id AS event_id, count(*) AS n_thresholds, max(prob) AS top_prob FROM sp GROUP BY 1),
g AS (SELECT event_id, count(*) AS n_signals, count_if(decision <> 'NO_TRADE') AS n_trades FROM sig GROUP BY 1)
SELECT event_id, n_signals, CAST(n_trades AS BIGINT) AS n_trades, n_thresholds, top_prob FROM g LEFT JOIN t USING (event_id)
""")
def run_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event (probabilities by strike, signal records), written and read back."""
    path, signals = scratch_path(spark, "run-report"), signal_table(spark, sf_dir)
    probs = sd.strike_probs(spark, sf_dir).withColumnRenamed("row_id", "event_id")
    meta = signals.select("event_id").distinct().withColumn("target", F.lit("price"))
    writers.write_run_report(writers.run_report(signals.select("event_id", "ticker", "decision", "edge"), probs, meta, ["event_id"]), path)
    back = spark.read.schema("event_id string, target string, threshold_probabilities map<string,double>, "
                             "signals array<struct<ticker:string,decision:string,edge:double>>").json(path)
    trades = F.size(F.filter("signals", lambda s: s["decision"] != "NO_TRADE"))
    return back.select("event_id", F.size("signals").cast("long").alias("n_signals"), trades.cast("long").alias("n_trades"),
                       F.size("threshold_probabilities").cast("long").alias("n_thresholds"),
                       F.array_max(F.map_values("threshold_probabilities")).alias("top_prob"))


@register("holdout_dump", ops="K4", sql="WITH " + PRED_SQL.split("base AS (")[0] + """
q AS (SELECT printf('%.6f', predicted_prob) AS prob, actual_label AS label, printf('%.3f', threshold) AS strike FROM pr)
SELECT prob, label, strike, count(*) AS n FROM q GROUP BY 1, 2, 3
""")
def holdout_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probability, label, strike) pairs dumped as formatted CSV, read back and counted."""
    path = scratch_path(spark, "holdout")
    writers.write_holdout_dump(sd.predictions(spark, sf_dir).select(
        F.col("predicted_prob").alias("prob"), F.col("actual_label").alias("label"), F.col("threshold").alias("strike")), path)
    back = spark.read.schema("prob string, label int, strike string").option("header", True).csv(f"{path}/csv")
    return back.groupBy("prob", "label", "strike").agg(F.count(F.lit(1)).alias("n"))


RUNS = ("1996-03-01", "1996-04-01")


@register("forecast_store", ops="K8 S10 P4", doubles=["value", "prev_value"], sql=f"""
WITH s AS (
  SELECT r.r_name AS series_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS run_ts,
         o.o_orderpriority AS channel, avg(o.o_totalprice) / 1000.0 AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderstatus <> 'P' GROUP BY 1, 2, 3)
SELECT c.series_id, c.channel, c.value, p.value AS prev_value
FROM s c LEFT JOIN s p ON p.series_id = c.series_id AND p.channel = c.channel AND p.run_ts = DATE '{RUNS[0]}'
WHERE c.run_ts = DATE '{RUNS[1]}'
""")
def forecast_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs saved as long rows (each from its wide form); the later one beside the one that the
    previous-forecast reader finds before it."""
    path = scratch_path(spark, "forecasts")
    snap = sd.forecast_snapshots(spark, sf_dir).where(F.col("version") == 1)
    channels = [r[0] for r in snap.select("channel").distinct().orderBy("channel").collect()]     # one a channel name
    for run in RUNS:
        wide = snap.where(F.col("run_ts") == F.lit(run).cast("date")).groupBy(*K).pivot("channel", channels).agg(F.first("value"))
        writers.save_current_forecast(wide, K, F.lit(run).cast("date"), path)
    held = spark.read.parquet(path)
    now = held.where(F.col("run_ts") == F.lit(RUNS[1]).cast("date")).select(*K, "channel", "value")
    before = landed.previous_forecast(held, F.lit(RUNS[1]).cast("date")).select(*K, "channel", F.col("value").alias("prev_value"))
    return now.join(before, [*K, "channel"], "left")


@register("snapshot_attach", ops="P12", doubles=["target", "top"], sql=f"""
WITH {S.RD},
m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS as_of, count(*) AS n_open, max(value) AS top FROM events GROUP BY 1),
a AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS as_of FROM rd)
SELECT a.series_id, a.date, a.target, a.as_of, CAST(m.n_open AS BIGINT) AS n_open, m.top FROM a LEFT JOIN m USING (as_of)
""")
def snapshot_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly event snapshots attached to the daily panel by their as-of month."""
    e = sd.table(spark, sf_dir, "events").select("ts", "value")
    snap = e.groupBy(F.to_date(F.date_trunc("month", "ts")).alias("as_of")).agg(
        F.count(F.lit(1)).alias("n_open"), F.max("value").alias("top"))
    panel = sd.region_daily(spark, sf_dir).select(*K, "date", "target", F.to_date(F.date_trunc("month", "date")).alias("as_of"))
    return ts.attach_snapshot(panel, snap, ["as_of"])


@register("ensemble_blend", ops="A19", doubles=["plain", "blended"], sql=TARGET_SQL + """
SELECT series_id, date, (target_lag_1 + target_lag_7 + target_rolling_7) / 3 AS plain,
       0.7 * (target_lag_1 + target_lag_7 + target_rolling_7) / 3 + 0.3 * target_rolling_30 AS blended
FROM t WHERE target IS NOT NULL
""")
def ensemble_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' mean and its blend with a meta prediction, as row expressions."""
    t = _target(spark, sf_dir).where(F.col("target").isNotNull())
    members = ["target_lag_1", "target_lag_7", "target_rolling_7"]
    return t.select(*K, "date", ml.ensemble_blend(members).alias("plain"),
                    ml.ensemble_blend(members, "target_rolling_30", 0.3).alias("blended"))


@register("saved_model_scores", ops="S12 K10 M10 (rows-only) bench:skip")
def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models fitted and saved, read back, and the test tail scored through them, as the daily job
    does with the model of an earlier run."""
    d, path = ml_frame(spark, sf_dir), scratch_path(spark, "paths")
    ml.fit_elastic_net(d.where(F.col("role") == "train"), ML_FEATS).save(path)
    net = elastic_path.load_paths(spark.read.parquet(path), ML_FEATS, K)
    return net.transform(d.where(F.col("role") == "test")).select(*K, "date", "target", "prediction")
