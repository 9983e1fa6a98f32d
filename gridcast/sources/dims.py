"""Small configuration dimensions (S11): series list for the cross-market snapshot and the
station / terminal tables. All are bounded by configuration, so broadcasting them is safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stand-in cross-market series: (series ticker, label). 'refund' has no quotes, so its label
# shows the zero-count / NULL-probability path.
CROSS_SERIES = [
    ("click", "click_daily"),
    ("purchase", "purchase_daily"),
    ("signup", "signup_daily"),
    ("error", "error_daily"),
    ("view", "view_daily"),
    ("refund", "refund_daily"),
]


def series_dim(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows or CROSS_SERIES, "series_ticker string, label string"))


def station_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Station / terminal dimension from config dicts (name, station_id, lat, lon, weight,
    region, scope)."""
    schema = ("name string, station_id string, lat double, lon double, weight double, "
              "region string, scope string")
    data = [(r.get("name"), r.get("station_id"), r.get("lat"), r.get("lon"), r.get("weight"),
             r.get("region"), r.get("scope")) for r in rows]
    return F.broadcast(spark.createDataFrame(data, schema))
