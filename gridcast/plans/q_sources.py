"""Registered source queries: landed JSON feeds read back through the typed readers (S1, S2,
S6, T4). The landing files are derived from the given tables by Spark, so their size grows
with the tables; the oracle is the same data computed directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators import geo
from gridcast.plans.registry import REGISTRY, register
from gridcast.session import scratch_path
from gridcast.sources import landed
from gridcast.sources import standins as sd


@register("landed_series_pages", ops="S1 S2 T4 F1 F2", doubles=["value"], sql="""
WITH lr AS (
  SELECT r.r_name AS series_id, l.l_quantity, l.l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
pg AS (SELECT series_id, year(l_shipdate) AS page, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
              sum(l_quantity) AS s FROM lr GROUP BY 1, 2, 3),
lp AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY page DESC) AS rn FROM pg)
SELECT series_id, date, CASE WHEN series_id = 'AFRICA' AND s < 100 THEN NULL ELSE s END AS value
FROM lp WHERE rn = 1
""")
def landed_series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly feed landed as yearly JSON pages (a week spanning New Year appears on two pages;
    the later page wins; small AFRICA values land as the text 'n/a')."""
    li = sd.lineitem_region(spark, sf_dir)
    wk = li.groupBy("series_id", F.year("l_shipdate").cast("long").alias("page"),
                    F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("s"))
    txt = F.when((F.col("series_id") == "AFRICA") & (F.col("s") < 100), F.lit("n/a")).otherwise(F.col("s").cast("string"))
    pages = wk.groupBy("series_id", "page").agg(F.collect_list(F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("period"), txt.alias("value"))).alias("data"))
    path = scratch_path(spark, "landing-series-pages")
    pages.select("series_id", "page", F.struct("data").alias("response")).write.json(path)
    return landed.read_series_pages(spark, path)


@register("forecast_payload_scopes", ops="S6 A5 A6 F1", doubles=["temp", "wind", "humidity", "max_wind", "weight_used"])
def forecast_payload_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station forecasts landed as nested payloads (daily[] with epoch seconds, alerts[]),
    exploded (first 2 days) and aggregated per scope."""
    f = sd.station_forecast_daily(spark, sf_dir)
    payload = f.select(
        F.col("station_id").cast("string").alias("station"),
        F.when(F.col("alert") == 1, F.array(F.struct(F.lit("storm").alias("event"))))
        .otherwise(F.array().cast("array<struct<event:string>>")).alias("alerts"),
        F.array(F.struct((F.unix_timestamp(F.col("date").cast("timestamp")) + 43200).alias("dt"),
                         F.struct(F.col("temp").alias("day")).alias("temp"),
                         F.col("wind").alias("wind_speed"), F.col("humidity").alias("humidity"))).alias("daily"))
    path = scratch_path(spark, "landing-forecast-payload")
    payload.write.json(path)
    obs = landed.read_forecast_payload(spark, path, days_ahead=2).withColumn(
        "station_id", F.col("station_id").cast("int"))
    return geo.forecast_scope_aggregate(obs, sd.station_dim(spark, sf_dir))


REGISTRY["forecast_payload_scopes"].sql = REGISTRY["storm_scope_flags"].sql
