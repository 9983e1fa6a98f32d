"""Shared DuckDB oracle fragments: the stand-in shapes of ``sources.standins`` written as SQL
CTE bodies over the pre-registered views."""

RD = """
rd AS (
  SELECT r.r_name AS series_id, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) / 1000.0 AS target, avg(o.o_totalprice) / 4000.0 AS temp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2)"""

# gap-free daily spine of rd with NULL values on missing days
PANEL = RD + """,
spine AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT series_id, CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi
        FROM rd GROUP BY 1)),
panel AS (
  SELECT s.series_id, s.date, rd.target, rd.temp,
         CASE WHEN rd.temp IS NOT NULL THEN greatest(65.0 - rd.temp, 0.0) END AS hdd,
         CASE WHEN rd.temp IS NOT NULL THEN greatest(rd.temp - 65.0, 0.0) END AS cdd
  FROM spine s LEFT JOIN rd ON s.series_id = rd.series_id AND s.date = rd.date)"""


def periodic(unit: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT r.r_name AS series_id, CAST(date_trunc('{unit}', l.l_shipdate) AS DATE) AS date,
         sum(l.l_quantity) AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2)"""


def ffill_spine(src: str, name: str, tail: int) -> str:
    return f"""
{name}_sp AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT series_id, CAST(min(date) AS TIMESTAMP) AS lo,
               CAST(max(date) + INTERVAL {tail} DAY AS TIMESTAMP) AS hi
        FROM {src} GROUP BY 1)),
{name} AS (
  SELECT s.series_id, s.date,
         last_value(x.value IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM {name}_sp s LEFT JOIN {src} x ON s.series_id = x.series_id AND s.date = x.date)"""


STATION_DAILY = """
sd AS (
  SELECT c.c_nationkey AS station_id, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) / 4000.0 AS temp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)"""

STATION_DIM = """
sdim AS (
  SELECT c.c_nationkey AS station_id, CAST(count(*) AS DOUBLE) AS weight, r.r_name AS region
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY c.c_nationkey, r.r_name)"""

SCOPE_TEMPS = STATION_DAILY + "," + STATION_DIM + """,
scoped AS (
  SELECT coalesce(d.region, 'national') AS scope, s.date,
         sum(CASE WHEN s.temp IS NOT NULL THEN s.temp * d.weight END)
           / nullif(sum(CASE WHEN s.temp IS NOT NULL THEN d.weight END), 0) AS temp,
         sum(CASE WHEN s.temp IS NOT NULL THEN d.weight END) AS weight_used
  FROM sd s JOIN sdim d ON s.station_id = d.station_id
  GROUP BY GROUPING SETS ((d.region, s.date), (s.date)))"""

MARKETS = """
rng AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1),
mk AS (
  SELECT p.p_brand AS event_id, 'MKT-' || CAST(p.p_partkey AS VARCHAR) AS ticker, p.p_partkey AS part_key,
         p.p_retailprice AS threshold_value,
         CAST(round(p.p_retailprice * 1000.0) AS BIGINT) AS strike_mills,
         CAST(CASE WHEN p.p_size <= 45 THEN
                CASE WHEN r.hi > r.lo THEN 1 + round(98.0 * (r.hi - p.p_retailprice) / (r.hi - r.lo)) ELSE 50 END
              END AS INTEGER) AS yes_ask_cents,
         CAST(p.p_size AS BIGINT) AS volume, CAST(p.p_size * 2 AS BIGINT) AS open_interest,
         p.p_size AS size
  FROM part p JOIN rng r ON p.p_brand = r.p_brand),
mkt AS (
  SELECT *, CAST(CASE WHEN yes_ask_cents IS NULL THEN NULL
                      ELSE 102 - yes_ask_cents + CASE WHEN size < 5 THEN size * 3 ELSE 0 END
                 END AS INTEGER) AS no_ask_cents
  FROM mk)"""

STRIKE_PROBS = """
sp AS (
  SELECT p_brand AS row_id, CAST(round(p_retailprice * 1000.0) AS BIGINT) AS strike_mills,
         max(p_size / 51.0) AS prob
  FROM part GROUP BY 1, 2)"""
