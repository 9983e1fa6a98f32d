"""Registered queries: panel assembly, spine / fill / as-of, upsert, tail patch, persistence,
today row, station pivot and weighted scopes (S3-S5, T1-T7, J1, J2, J10, U1-U2, A1-A6, P4,
P11, P14)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators import geo
from gridcast.operators import timeseries as ts
from gridcast.plans import sqlparts as S
from gridcast.plans.registry import register
from gridcast.sources import standins as sd

K = ["series_id"]


def panel_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily panel per region with hdd / cdd (NULL on days without data)."""
    rd = sd.region_daily(spark, sf_dir)
    p = ts.gap_free_spine(rd, K, ["target", "temp"])
    return p.withColumn("hdd", ts.hdd(F.col("temp"))).withColumn("cdd", ts.cdd(F.col("temp")))


# --------------------------------------------------------------------------- J1

@register("daily_panel_outer_join", ops="J1 O1 S1", doubles=["target", "ship_qty", "urgent_temp"], sql=f"""
WITH {S.RD},
ship AS (
  SELECT r.r_name AS series_id, CAST(l.l_shipdate AS DATE) AS date, sum(l.l_quantity) AS ship_qty
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2),
urg AS (
  SELECT r.r_name AS series_id, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) / 4000.0 AS urgent_temp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderpriority = '1-URGENT' GROUP BY 1, 2),
j1 AS (
  SELECT coalesce(rd.series_id, ship.series_id) AS series_id, coalesce(rd.date, ship.date) AS date,
         rd.target, ship.ship_qty
  FROM rd FULL OUTER JOIN ship ON rd.series_id = ship.series_id AND rd.date = ship.date)
SELECT coalesce(j1.series_id, urg.series_id) AS series_id, coalesce(j1.date, urg.date) AS date,
       j1.target, j1.ship_qty, urg.urgent_temp
FROM j1 FULL OUTER JOIN urg ON j1.series_id = urg.series_id AND j1.date = urg.date
""")
def daily_panel_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = sd.region_daily(spark, sf_dir).select(*K, "date", "target")
    li = sd.lineitem_region(spark, sf_dir)
    ship = li.groupBy("series_id", F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("ship_qty"))
    o = sd.orders_by_customer_region(spark, sf_dir)
    urg = (o.where(F.col("o_orderpriority") == "1-URGENT")
           .groupBy(F.col("r_name").alias("series_id"), F.to_date("o_orderdate").alias("date"))
           .agg((F.avg("o_totalprice") / 4000.0).alias("urgent_temp")))
    return ts.outer_join_all([price, ship, urg], [*K, "date"])


# --------------------------------------------------------------------------- T1 / T2 / S3 / S4

@register("spine_ffill_weekly", ops="T1 T2 S3 J2", doubles=["value"], sql=f"""
WITH {S.periodic('week', 'wk')}, {S.ffill_spine('wk', 'wf', 10)}
SELECT series_id, date, value FROM wf
""")
def spine_ffill_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    wk = sd.periodic_feed(spark, sf_dir, "week")
    return ts.gap_free_spine(wk, K, ["value"], tail_days=10, fill=True)


@register("spine_ffill_monthly", ops="T1 T2 S4 J2", doubles=["value"], sql=f"""
WITH {S.periodic('month', 'mo')}, {S.ffill_spine('mo', 'mf', 40)}
SELECT series_id, date, value FROM mf
""")
def spine_ffill_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    mo = sd.periodic_feed(spark, sf_dir, "month")
    return ts.gap_free_spine(mo, K, ["value"], tail_days=40, fill=True)


@register("asof_available_at", ops="J2 (available_at, tolerance)", doubles=["value"], sql=f"""
WITH {S.RD}, {S.periodic('week', 'wk')},
obs AS (SELECT series_id, date AS source_date, date + INTERVAL 10 DAY AS avail, value FROM wk),
m AS (
  SELECT s.series_id, s.date, o.value, o.source_date
  FROM (SELECT series_id, date FROM rd) s
  ASOF LEFT JOIN obs o ON s.series_id = o.series_id AND s.date >= o.avail)
SELECT series_id, date,
       CASE WHEN date_diff('day', source_date, date) <= 60 THEN value END AS value,
       CASE WHEN date_diff('day', source_date, date) <= 60 THEN CAST(source_date AS DATE) END
         AS source_date
FROM m
""")
def asof_available_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly value onto the daily price dates, usable 10 days after the period start
    (release lag), matches older than 60 days dropped."""
    spine = sd.region_daily(spark, sf_dir).select(*K, "date")
    wk = sd.periodic_feed(spark, sf_dir, "week").withColumn(
        "available_at", F.date_add("date", 10))
    return ts.asof_backward(spine, wk, K, ["value"], available_at="available_at",
                            tolerance_days=60)


# --------------------------------------------------------------------------- T4 / U1 / U2

@register("dedupe_upsert", ops="T4 U1 U2 K9", doubles=["temp"], sql=f"""
WITH {S.STATION_DAILY},
fresh AS (
  SELECT c.c_nationkey AS station_id, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) / 4000.0 AS temp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus = 'O' GROUP BY 1, 2),
u AS (SELECT station_id, date, temp, 'cache' AS src, 0 AS prio FROM sd
      UNION ALL SELECT station_id, date, temp, 'fresh' AS src, 1 AS prio FROM fresh)
SELECT station_id, date, temp, src FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, date ORDER BY prio DESC) AS rn FROM u)
WHERE rn = 1
""")
def dedupe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = sd.station_daily(spark, sf_dir).withColumn("src", F.lit("cache"))
    o = sd.orders_by_customer_region(spark, sf_dir)
    fresh = (o.where(F.col("o_orderstatus") == "O")
             .groupBy(F.col("c_nationkey").alias("station_id"), F.to_date("o_orderdate").alias("date"))
             .agg((F.avg("o_totalprice") / 4000.0).alias("temp"))
             .withColumn("src", F.lit("fresh")))
    return ts.upsert(cache, fresh, ["station_id", "date"]).select("station_id", "date", "temp", "src")


# --------------------------------------------------------------------------- T3 / P11

TAIL_ANCHOR = "2001-08-04"
TAIL_BOUNDS = (245.0, 255.0)


@register("stale_tail_patch", ops="T3 P11", doubles=["target"], sql=f"""
WITH {S.RD},
est AS (
  SELECT r.r_name AS series_id, avg(o.o_totalprice) / 1000.0 AS estimate
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderpriority = '1-URGENT' GROUP BY 1),
lastobs AS (
  SELECT series_id, max(date) AS d, arg_max(target, date) AS v FROM rd
  WHERE target IS NOT NULL GROUP BY 1),
e AS (SELECT est.series_id, est.estimate, l.d, l.v, DATE '{TAIL_ANCHOR}' AS anchor
      FROM est JOIN lastobs l ON est.series_id = l.series_id
      WHERE est.estimate BETWEEN {TAIL_BOUNDS[0]} AND {TAIL_BOUNDS[1]}),
gap AS (
  SELECT series_id, CAST(g AS DATE) AS date,
         CASE WHEN CAST(g AS DATE) = anchor THEN estimate ELSE v END AS patch
  FROM (SELECT *, unnest(generate_series(CAST(d + INTERVAL 1 DAY AS TIMESTAMP),
                                         CAST(anchor AS TIMESTAMP), INTERVAL 1 DAY)) AS g
        FROM e WHERE d < anchor)),
anchor_only AS (SELECT series_id, anchor AS date, estimate AS patch FROM e WHERE d >= anchor),
patches AS (SELECT * FROM gap UNION ALL SELECT * FROM anchor_only)
SELECT coalesce(rd.series_id, p.series_id) AS series_id, coalesce(rd.date, p.date) AS date,
       coalesce(p.patch, rd.target) AS target
FROM rd FULL OUTER JOIN patches p ON rd.series_id = p.series_id AND rd.date = p.date
""")
def stale_tail_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor = a fixed as-of date parameter; estimate = urgent-order price level per region;
    sanity band [245, 255]."""
    rd = sd.region_daily(spark, sf_dir).select(*K, "date", "target")
    o = sd.orders_by_customer_region(spark, sf_dir)
    est = (o.where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("r_name").alias("series_id"))
           .agg((F.avg("o_totalprice") / 1000.0).alias("estimate")))
    return ts.stale_tail_patch(rd, est, K, "target", F.lit(TAIL_ANCHOR).cast("date"),
                               TAIL_BOUNDS[0], TAIL_BOUNDS[1]).select(*K, "date", "target")


# --------------------------------------------------------------------------- T5 / O5

@register("persistence_forecast", ops="T5 A9 O5", doubles=["target", "temp"], sql=f"""
WITH {S.RD},
l AS (SELECT series_id, max(date) AS d, arg_max(target, date) AS target, arg_max(temp, date) AS temp
      FROM rd GROUP BY 1)
SELECT series_id, CAST(d + h * INTERVAL 1 DAY AS DATE) AS date, CAST(h AS INTEGER) AS horizon, target, temp
FROM l, (SELECT unnest(range(1, 4)) AS h) hs
""")
def persistence_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir)
    out = ts.persistence_forecast(rd, K, ["target", "temp"], horizon=3)
    return out.withColumn("horizon", F.col("horizon").cast("int"))


# --------------------------------------------------------------------------- P14

@register("today_row", ops="P14 P2 P3 W1 W11 W12", doubles=["temp", "target_lag_1", "target_lag_7",
                                                 "target_rolling_7", "temp_lag_1", "hdd"], sql=f"""
WITH {S.RD},
l AS (SELECT series_id, max(date) AS d, arg_max(temp, date) AS temp FROM rd GROUP BY 1),
today AS (SELECT series_id, CAST(d + INTERVAL 1 DAY AS DATE) AS date, CAST(NULL AS DOUBLE) AS target,
                 temp FROM l),
hist AS (SELECT * FROM rd WHERE NOT EXISTS (
           SELECT 1 FROM today t WHERE t.series_id = rd.series_id AND t.date = rd.date)),
u AS (SELECT series_id, date, target, temp FROM hist UNION ALL SELECT * FROM today),
sp AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT series_id, CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi
        FROM u GROUP BY 1)),
p AS (SELECT s.series_id, s.date, u.target, u.temp FROM sp s LEFT JOIN u
      ON s.series_id = u.series_id AND s.date = u.date),
f AS (
  SELECT series_id, date, temp,
    lag(target, 1) OVER w AS target_lag_1, lag(target, 7) OVER w AS target_lag_7,
    CASE WHEN count(target) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 3
         THEN avg(target) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS target_rolling_7,
    lag(temp, 1) OVER w AS temp_lag_1,
    CASE WHEN temp IS NOT NULL THEN greatest(65.0 - temp, 0.0) END AS hdd
  FROM p WINDOW w AS (PARTITION BY series_id ORDER BY date))
SELECT f.* FROM f JOIN today t ON f.series_id = t.series_id AND f.date = t.date
""")
def today_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir)
    fc = ts.persistence_forecast(rd, K, ["temp"], horizon=1).drop("horizon")
    return ts.today_features(rd, fc, K)


# --------------------------------------------------------------------------- S5 / P4 / A4

PIVOT_SQL = """
st AS (
  SELECT s.s_nationkey AS station_id, CAST(l.l_shipdate AS DATE) AS date,
         CASE l.l_returnflag WHEN 'A' THEN 'TMAX' WHEN 'R' THEN 'TMIN' WHEN 'N' THEN 'TAVG' END
           AS datatype,
         avg(l.l_extendedprice) / 1000.0 AS value
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2, 3),
pv AS (
  SELECT station_id, date,
         max(CASE WHEN datatype = 'TAVG' THEN value END) AS tavg,
         max(CASE WHEN datatype = 'TMAX' THEN value END) AS tmax,
         max(CASE WHEN datatype = 'TMIN' THEN value END) AS tmin
  FROM st WHERE datatype IN ('TAVG', 'TMAX', 'TMIN') GROUP BY 1, 2)"""


@register("pivot_station_metrics", ops="S5 P4", doubles=["tavg", "tmax", "tmin"],
          sql=f"WITH {PIVOT_SQL} SELECT * FROM pv")
def pivot_station_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.pivot_metrics(sd.station_metrics_long(spark, sf_dir), ["station_id", "date"])


@register("midpoint_fallback", ops="A4", doubles=["tavg", "tmax", "tmin", "tavg_filled"], sql=f"""
WITH {PIVOT_SQL}
SELECT *, coalesce(tavg, (tmax + tmin) / 2.0) AS tavg_filled FROM pv
""")
def midpoint_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = geo.pivot_metrics(sd.station_metrics_long(spark, sf_dir), ["station_id", "date"])
    return pv.withColumn("tavg_filled", geo.midpoint_fallback())


# --------------------------------------------------------------------------- A1 / A2 / J10 / T6 / T7

@register("weighted_scope_mean", ops="A1 A2 J10", doubles=["temp", "weight_used"],
          sql=f"WITH {S.SCOPE_TEMPS} SELECT scope, date, temp, weight_used FROM scoped")
def weighted_scope_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.scope_weighted_mean(sd.station_daily(spark, sf_dir), sd.station_dim(spark, sf_dir),
                                   ["temp"])


@register("degree_days", ops="T6 A3", doubles=["temp", "hdd", "cdd"], sql=f"""
WITH {S.SCOPE_TEMPS}
SELECT scope, date, temp,
       CASE WHEN temp IS NOT NULL THEN greatest(65.0 - temp, 0.0) END AS hdd,
       CASE WHEN temp IS NOT NULL THEN greatest(temp - 65.0, 0.0) END AS cdd
FROM scoped
""")
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geo.scope_weighted_mean(sd.station_daily(spark, sf_dir), sd.station_dim(spark, sf_dir), ["temp"])
    return s.select("scope", "date", "temp", ts.hdd(F.col("temp")).alias("hdd"),
                    ts.cdd(F.col("temp")).alias("cdd"))


@register("trailing_anomaly", ops="T7", doubles=["hdd", "cdd", "hdd_anomaly_30d", "cdd_anomaly_30d"], sql=f"""
WITH {S.SCOPE_TEMPS},
dd AS (SELECT scope, date,
              CASE WHEN temp IS NOT NULL THEN greatest(65.0 - temp, 0.0) END AS hdd,
              CASE WHEN temp IS NOT NULL THEN greatest(temp - 65.0, 0.0) END AS cdd
       FROM scoped)
SELECT scope, date, hdd, cdd,
  hdd - CASE WHEN count(hdd) OVER w >= 10 THEN avg(hdd) OVER w END AS hdd_anomaly_30d,
  cdd - CASE WHEN count(cdd) OVER w >= 10 THEN avg(cdd) OVER w END AS cdd_anomaly_30d
FROM dd
WINDOW w AS (PARTITION BY scope ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
""")
def trailing_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geo.scope_weighted_mean(sd.station_daily(spark, sf_dir), sd.station_dim(spark, sf_dir), ["temp"])
    s = s.select("scope", "date", ts.hdd(F.col("temp")).alias("hdd"), ts.cdd(F.col("temp")).alias("cdd"))
    return s.select("scope", "date", "hdd", "cdd",
                    ts.trailing_anomaly(F.col("hdd"), ["scope"]).alias("hdd_anomaly_30d"),
                    ts.trailing_anomaly(F.col("cdd"), ["scope"]).alias("cdd_anomaly_30d"))


@register("seasonal_norm", ops="T7 (seasonal) D1", doubles=["target", "target_norm", "target_dev"], sql=f"""
WITH {S.RD}
SELECT series_id, date, target, avg(target) OVER w AS target_norm, target - avg(target) OVER w AS target_dev
FROM rd
WINDOW w AS (PARTITION BY series_id, dayofyear(date) ORDER BY year(date)
             RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def seasonal_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir)
    return ts.seasonal_norm(rd, K, "target", years=5)


# --------------------------------------------------------------------------- A5 / A6

@register("storm_scope_flags", ops="A5 A6 S6", doubles=["temp", "wind", "humidity", "max_wind", "weight_used"],
          sql=f"""
WITH {S.STATION_DIM},
fd AS (
  SELECT s.s_nationkey AS station_id, CAST(l.l_shipdate AS DATE) AS date,
         avg(l.l_extendedprice) / 1000.0 AS temp, avg(l.l_quantity) AS wind,
         avg(l.l_tax) * 1000.0 AS humidity,
         max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS alert
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT coalesce(d.region, 'national') AS scope, f.date,
  sum(CASE WHEN f.temp IS NOT NULL THEN f.temp * d.weight END)
    / nullif(sum(CASE WHEN f.temp IS NOT NULL THEN d.weight END), 0) AS temp,
  sum(CASE WHEN f.wind IS NOT NULL THEN f.wind * d.weight END)
    / nullif(sum(CASE WHEN f.wind IS NOT NULL THEN d.weight END), 0) AS wind,
  sum(CASE WHEN f.humidity IS NOT NULL THEN f.humidity * d.weight END)
    / nullif(sum(CASE WHEN f.humidity IS NOT NULL THEN d.weight END), 0) AS humidity,
  max(f.wind) AS max_wind,
  CAST(greatest(max(CASE WHEN f.wind > 35.0 THEN 1 ELSE 0 END), max(f.alert)) AS INTEGER) AS storm_flag,
  CAST(CASE WHEN max(f.wind) > 40.0 OR max(f.alert) = 1 THEN 1 ELSE 0 END AS INTEGER) AS gulf_flag,
  sum(d.weight) AS weight_used
FROM fd f JOIN sdim d ON f.station_id = d.station_id
GROUP BY GROUPING SETS ((d.region, f.date), (f.date))
""")
def storm_scope_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.forecast_scope_aggregate(sd.station_forecast_daily(spark, sf_dir),
                                        sd.station_dim(spark, sf_dir))


# --------------------------------------------------------------------------- P5 (panel build)

PANEL_AS_OF = "2001-08-01"
PANEL_DAYS = 365


@register("panel_trim", ops="J1 T2 S3 S4 P5 O1", doubles=["target", "storage", "production"], sql=f"""
WITH {S.RD}, {S.periodic('week', 'wk')}, {S.ffill_spine('wk', 'wf', 10)},
     {S.periodic('month', 'mo')}, {S.ffill_spine('mo', 'mf', 40)},
a AS (SELECT series_id, date, target FROM rd WHERE date >= DATE '{PANEL_AS_OF}' - INTERVAL {PANEL_DAYS} DAY),
b AS (SELECT series_id, date, value AS storage FROM wf WHERE date >= DATE '{PANEL_AS_OF}' - INTERVAL {PANEL_DAYS} DAY),
c AS (SELECT series_id, date, value AS production FROM mf WHERE date >= DATE '{PANEL_AS_OF}' - INTERVAL {PANEL_DAYS} DAY),
ab AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.date, b.date) AS date, a.target, b.storage
       FROM a FULL OUTER JOIN b ON a.series_id = b.series_id AND a.date = b.date)
SELECT coalesce(ab.series_id, c.series_id) AS series_id, coalesce(ab.date, c.date) AS date,
       ab.target, ab.storage, c.production
FROM ab FULL OUTER JOIN c ON ab.series_id = c.series_id AND ab.date = c.date
""")
def panel_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel = price + weekly (ffill, 10-day tail) + monthly (ffill, 40-day tail) feeds,
    outer-joined and trimmed to the last 365 days before the as-of date; every feed is filled
    over its full history first and trimmed before the join (P5), NaN/inf mapped to NULL (P8)."""
    as_of = F.lit(PANEL_AS_OF).cast("date")
    price = ts.trim_window(sd.region_daily(spark, sf_dir).select(*K, "date", "target"), as_of, PANEL_DAYS)
    wk = ts.gap_free_spine(sd.periodic_feed(spark, sf_dir, "week"), K, ["value"], tail_days=10, fill=True)
    mo = ts.gap_free_spine(sd.periodic_feed(spark, sf_dir, "month"), K, ["value"], tail_days=40, fill=True)
    wk = ts.trim_window(wk.withColumnRenamed("value", "storage"), as_of, PANEL_DAYS)
    mo = ts.trim_window(mo.withColumnRenamed("value", "production"), as_of, PANEL_DAYS)
    return ts.finite_all(ts.outer_join_all([price, wk, mo], [*K, "date"]))
