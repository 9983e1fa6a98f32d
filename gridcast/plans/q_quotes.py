"""Registered queries: quotes, snapshot, implied level, ladder, grids, signals, validators
(F2, F4, F5, A7, L1-L8, F11, F12, A12, G1-G5, J3, K7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip, gaussian_tail
from gridcast.operators import gates, ladder, quotes
from gridcast.plans import sqlparts as S
from gridcast.plans.q_timeseries import K
from gridcast.plans.registry import register
from gridcast.sources import standins as sd
from gridcast.sources.dims import series_dim

RAW_QUOTES = """
rq AS (
  SELECT event_id, event_type AS series_ticker, event_type || '-' || CAST(user_id AS VARCHAR) AS ticker,
    CASE WHEN event_type = 'view' THEN 'closed' ELSE 'open' END AS status,
    CASE WHEN event_type = 'error' THEN '' ELSE json_extract_string(props, '$.k') END AS yes_ask,
    CASE WHEN event_type = 'error'
         THEN printf('%.2f', CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0) END AS yes_ask_dollars,
    CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(value AS VARCHAR) END AS volume,
    CAST(value AS VARCHAR) AS volume_fp
  FROM events),
pq AS (
  SELECT *, coalesce(TRY_CAST(nullif(yes_ask, '') AS DOUBLE) / 100.0,
                     TRY_CAST(nullif(yes_ask_dollars, '') AS DOUBLE)) AS prob,
    CAST(CASE WHEN nullif(volume, '') IS NOT NULL
              THEN coalesce(CAST(trunc(TRY_CAST(volume AS DOUBLE)) AS BIGINT), 0)
              WHEN nullif(volume_fp, '') IS NOT NULL
              THEN coalesce(CAST(trunc(TRY_CAST(volume_fp AS DOUBLE)) AS BIGINT), 0)
              ELSE 0 END AS BIGINT) AS volume_int
  FROM rq)"""


@register("quote_price_chain", ops="F2 F4 F5 F6 S7", doubles=["prob"], sql=f"""
WITH {RAW_QUOTES}
SELECT event_id, series_ticker, ticker, status, prob, volume_int FROM pq
""")
def quote_price_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes.priced_quotes(sd.raw_quotes(spark, sf_dir))
    return q.select("event_id", "series_ticker", "ticker", "status", "prob", "volume_int")


def _dim_sql() -> str:
    from gridcast.sources.dims import CROSS_SERIES
    vals = ", ".join(f"('{s}', '{lb}')" for s, lb in CROSS_SERIES)
    return f"dim(series_ticker, label) AS (VALUES {vals})"


@register("series_snapshot", ops="A7 S7 S11", doubles=["avg_prob", "max_prob"], sql=f"""
WITH {RAW_QUOTES}, {_dim_sql()},
a AS (SELECT series_ticker, count(*) AS n_open, sum(volume_int) AS vol_sum, avg(prob) AS avg_prob,
             max(prob) AS max_prob FROM pq WHERE status = 'open' GROUP BY 1)
SELECT d.label, CAST(coalesce(a.n_open, 0) AS BIGINT) AS n_open,
       CAST(coalesce(a.vol_sum, 0) AS BIGINT) AS vol_sum, a.avg_prob, a.max_prob
FROM dim d LEFT JOIN a ON d.series_ticker = a.series_ticker
""")
def series_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.series_snapshot(sd.raw_quotes(spark, sf_dir), series_dim(spark))


@register("implied_level_crossing", ops="L7 W19 S8", doubles=["implied_level"], sql=f"""
WITH {S.MARKETS},
m AS (SELECT event_id, threshold_value AS k, CAST(yes_ask_cents AS DOUBLE) AS a, ticker FROM mkt
      WHERE threshold_value IS NOT NULL AND yes_ask_cents IS NOT NULL),
s AS (SELECT event_id, k, a, row_number() OVER w AS rn, lead(k) OVER w AS k2, lead(a) OVER w AS a2
      FROM m WINDOW w AS (PARTITION BY event_id ORDER BY k, ticker)),
g AS (SELECT event_id, count(*) AS n_strikes,
        arg_min(CASE WHEN a - a2 <= 0 THEN k ELSE k + (a - 50.0) / (a - a2) * (k2 - k) END, rn)
          FILTER (WHERE a >= 50.0 AND a2 <= 50.0) AS x,
        arg_min(k, rn) AS lo_k, arg_min(a, rn) AS lo_a, arg_max(k, rn) AS hi_k, arg_max(a, rn) AS hi_a
      FROM s GROUP BY 1)
SELECT event_id, CASE WHEN n_strikes < 2 THEN NULL WHEN x IS NOT NULL THEN x
                      WHEN lo_a < 50.0 THEN lo_k WHEN hi_a > 50.0 THEN hi_k END AS implied_level,
       n_strikes
FROM g
""")
def implied_level_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.implied_level(sd.markets(spark, sf_dir), ["event_id"])


# --------------------------------------------------------------------------- ladder

@register("ladder_monotone", ops="L1 W18", doubles=["prob", "fixed_prob"], sql=f"""
WITH {S.STRIKE_PROBS}
SELECT row_id, strike_mills, prob,
       min(prob) OVER (PARTITION BY row_id ORDER BY strike_mills
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixed_prob
FROM sp
""")
def ladder_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = sd.strike_probs(spark, sf_dir).select("row_id", "strike_mills", "prob")
    return ladder.monotone(sp, ["row_id"])


INTERP_SQL = f"""
WITH {S.STRIKE_PROBS},
tr AS (SELECT row_id, strike_mills / 1000.0 AS k,
              min(prob) OVER (PARTITION BY row_id ORDER BY strike_mills
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM sp),
wn AS (SELECT p_brand AS row_id, p_partkey AS part_key, p_retailprice + (p_size - 25) / 10.0 AS k FROM part),
u AS (SELECT row_id, k, 0 AS side, k AS tk, p AS tp, CAST(NULL AS BIGINT) AS part_key FROM tr
      UNION ALL SELECT row_id, k, 1 AS side, NULL, NULL, part_key FROM wn),
s AS (SELECT *,
        last_value(tk IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lok,
        last_value(tp IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lop,
        first_value(tk IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hik,
        first_value(tp IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hip
      FROM u)
SELECT row_id, part_key, k AS strike,
  CASE WHEN lop IS NULL AND hip IS NULL THEN 0.5
       WHEN lop IS NULL THEN least(greatest(hip, 0.01), 0.99)
       WHEN hip IS NULL THEN least(greatest(lop, 0.01), 0.99)
       WHEN hik <= lok THEN least(greatest(lop, 0.01), 0.99)
       ELSE least(greatest((1.0 - (k - lok) / (hik - lok)) * lop + ((k - lok) / (hik - lok)) * hip, 0.01), 0.99)
  END AS prob
FROM s WHERE side = 1
"""


def _trained_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = sd.strike_probs(spark, sf_dir)
    return ladder.monotone(sp, ["row_id"]).select("row_id", "strike_mills",
                                                  (F.col("strike_mills") / 1000.0).alias("strike"),
                                                  "fixed_prob")


@register("ladder_interpolate", ops="L2 L3 J4", doubles=["strike", "prob"], sql=INTERP_SQL)
def ladder_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = _trained_ladder(spark, sf_dir)
    p = sd.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("row_id"), F.col("p_partkey").alias("part_key"),
        (F.col("p_retailprice") + (F.col("p_size") - 25) / F.lit(10.0)).alias("strike"))
    return ladder.interpolate(tr, p, ["row_id"]).select("row_id", "part_key", "strike", "prob")


def _ncdf_sql(x: str) -> str:
    # same Abramowitz-Stegun 7.1.26 expression as functions.scalar.normal_cdf
    z = f"(abs({x}) / {math.sqrt(2.0)!r})"
    t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
            f"(-1.453152027 + {t} * 1.061405429)))))")
    erf = f"(1.0 - {poly} * exp(-{z} * {z}))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1.0 + {erf}) ELSE 0.5 * (1.0 - {erf}) END)"


@register("gaussian_tail", ops="F12 D6", doubles=["target", "prob_above"], sql=f"""
WITH {S.RD}
SELECT series_id, date, target,
       1.0 - {_ncdf_sql("((250.0 - target) / greatest(40.0, 1e-6))")} AS prob_above
FROM rd
""")
def gaussian_tail_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(x >= 250) with x ~ N(target, 40): the no-classifier fallback on every panel row."""
    rd = sd.region_daily(spark, sf_dir)
    return rd.select(*K, "date", "target",
                     gaussian_tail(F.lit(250.0), F.col("target"), F.lit(40.0)).alias("prob_above"))


@register("dynamic_grid", ops="L4 F11 A9", doubles=["strike"], sql=f"""
WITH {S.RD},
c AS (SELECT series_id, arg_max(target, date) AS f, stddev_samp(target) AS sigma FROM rd GROUP BY 1),
g AS (SELECT series_id, round_even(f / 5.0, 0) * 5.0 AS ctr,
             greatest(CAST(round_even(2.5 * sigma / 5.0, 0) AS INTEGER), 10) AS h FROM c)
SELECT series_id, CAST(i AS INTEGER) AS i, round_even(ctr + i * 5.0, 4) AS strike
FROM (SELECT series_id, ctr, unnest(range(-h, h + 1)) AS i FROM g)
""")
def dynamic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid around each series' last value, half-width from 2.5 sigma, step 5."""
    rd = sd.region_daily(spark, sf_dir)
    c = rd.groupBy(*K).agg(F.max_by("target", "date").alias("forecast"),
                           F.stddev_samp("target").alias("sigma"))
    return ladder.dynamic_grid(c, K, step=5.0)


TGRID_SQL = f"""
WITH {S.RD},
q AS (SELECT series_id, floor(quantile_cont(target, 0.05) / 10.0) * 10.0 AS lo,
             ceil(quantile_cont(target, 0.95) / 10.0) * 10.0 AS hi FROM rd GROUP BY 1),
tg AS (SELECT series_id, round(lo + i * 10.0, 3) AS strike
       FROM (SELECT series_id, lo, unnest(range(0, CAST(round_even((hi - lo) / 10.0, 0) AS INTEGER) + 1)) AS i FROM q))
"""


@register("training_grid", ops="L5 A12 L6", doubles=["strike"], sql=TGRID_SQL + "SELECT * FROM tg")
def training_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.training_grid(sd.region_daily(spark, sf_dir), K, "target", step=10.0)


@register("threshold_labels", ops="L8 A17", doubles=["target", "strike"], sql=TGRID_SQL + """
SELECT rd.series_id, rd.date, rd.target, tg.strike, CAST(rd.target >= tg.strike AS INTEGER) AS label
FROM rd JOIN tg ON rd.series_id = tg.series_id
""")
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = sd.region_daily(spark, sf_dir).select(*K, "date", "target")
    g = ladder.training_grid(rd, K, "target", step=10.0)
    return ladder.threshold_labels(rd, g, K, "target")


@register("class_counts", ops="A17 L8", doubles=["strike"], sql=TGRID_SQL + """
SELECT rd.series_id, tg.strike, count(*) AS n, CAST(count_if(rd.target >= tg.strike) AS BIGINT) AS n_pos
FROM rd JOIN tg ON rd.series_id = tg.series_id GROUP BY 1, 2
""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and positives of every strike of the training grid, as threshold_labels would count."""
    rd = sd.region_daily(spark, sf_dir).select(*K, "date", "target")
    return ladder.class_counts(rd, ladder.training_grid(rd, K, "target", step=10.0), K, "target")


# --------------------------------------------------------------------------- signals / gates

SIG_COLS = ["event_id", "ticker", "threshold_value", "strike_mills", "yes_ask_cents", "no_ask_cents",
            "volume", "open_interest", "model_prob", "market_implied_prob", "edge", "spread_cents",
            "decision", "reason_code"]

SIGNALS_SQL = f"""
WITH {S.MARKETS}, {S.STRIKE_PROBS},
tr AS (SELECT row_id AS event_id, strike_mills,
              least(greatest(min(prob) OVER (PARTITION BY row_id ORDER BY strike_mills
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.01), 0.99) AS p
       FROM sp WHERE prob >= 3 / 51.0),
j AS (SELECT mkt.*, tr.p AS mp, (tr.p IS NOT NULL AND mkt.threshold_value IS NOT NULL) AS matched,
             coalesce(mkt.yes_ask_cents / 100.0, 0.0) AS kp,
             tr.p - coalesce(mkt.yes_ask_cents / 100.0, 0.0) AS e,
             CAST(mkt.no_ask_cents - (100 - mkt.yes_ask_cents) AS INTEGER) AS s
      FROM mkt LEFT JOIN tr ON mkt.event_id = tr.event_id AND mkt.strike_mills = tr.strike_mills),
c AS (SELECT *, CASE
        WHEN NOT matched THEN 'no_threshold_match'
        WHEN volume < 25 THEN 'volume_too_low'
        WHEN open_interest < 25 THEN 'open_interest_too_low'
        WHEN s IS NOT NULL AND s > 10 THEN 'spread_too_wide'
        WHEN e >= 0.05 AND yes_ask_cents IS NOT NULL AND yes_ask_cents > 75 THEN 'entry_too_expensive_yes'
        WHEN e >= 0.05 THEN 'edge_yes'
        WHEN e <= -0.05 AND no_ask_cents IS NOT NULL AND no_ask_cents > 75 THEN 'entry_too_expensive_no'
        WHEN e <= -0.05 THEN 'edge_no'
        ELSE 'insufficient_edge' END AS reason_code
      FROM j),
sig AS (
  SELECT event_id, ticker, threshold_value, strike_mills, yes_ask_cents, no_ask_cents, volume, open_interest,
    CASE WHEN matched THEN mp ELSE 0.0 END AS model_prob,
    CASE WHEN matched THEN kp ELSE 0.0 END AS market_implied_prob,
    CASE WHEN matched THEN e ELSE 0.0 END AS edge,
    CASE WHEN matched THEN s END AS spread_cents,
    CASE reason_code WHEN 'edge_yes' THEN 'BUY_YES' WHEN 'edge_no' THEN 'BUY_NO' ELSE 'NO_TRADE' END AS decision,
    reason_code
  FROM c)
"""


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sd.markets(spark, sf_dir)
    sp = sd.strike_probs(spark, sf_dir).where(F.col("prob") >= 3 / 51.0)
    tr = ladder.monotone(sp, ["row_id"]).select(F.col("row_id").alias("event_id"), "strike_mills",
                                                clip(F.col("fixed_prob"), 0.01, 0.99).alias("prob"))
    return gates.compute_signals(m, tr, ["event_id", "strike_mills"])


@register("signals", ops="G1 G2 G3 J3 F6 P13", doubles=["threshold_value", "model_prob", "market_implied_prob", "edge"],
          sql=SIGNALS_SQL + f"SELECT {', '.join(SIG_COLS)} FROM sig")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_table(spark, sf_dir).select(*SIG_COLS)


@register("gate_audit", ops="G5", sql=SIGNALS_SQL + """
SELECT decision, reason_code, count(*) AS n FROM sig GROUP BY 1, 2
""")
def gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_audit(signal_table(spark, sf_dir))


@register("market_views", ops="K7 B1 P10", doubles=["threshold_value", "model_prob", "edge_yes", "edge_no"],
          sql=SIGNALS_SQL + """
SELECT ticker, threshold_value, model_prob, yes_ask_cents, no_ask_cents, spread_cents,
       CASE WHEN edge >= 0 THEN edge END AS edge_yes, CASE WHEN edge < 0 THEN -edge END AS edge_no,
       CASE WHEN decision IN ('BUY_YES', 'BUY_NO') THEN decision ELSE 'SKIP' END AS verdict,
       reason_code AS rejection_reason, volume, open_interest,
       CASE decision WHEN 'BUY_YES' THEN yes_ask_cents WHEN 'BUY_NO' THEN no_ask_cents END AS side_ask_cents
FROM sig
""")
def market_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.market_views(signal_table(spark, sf_dir))


@register("validate_markets", ops="G4 D8 D9", doubles=["threshold_value", "forecast_value", "minutes_to_close"], sql=f"""
WITH {S.MARKETS},
fc AS (SELECT event_id, avg(threshold_value) AS forecast_value FROM mkt GROUP BY 1),
v AS (SELECT mkt.*, fc.forecast_value, CAST((size - 1) * 250 + 20 AS DOUBLE) AS minutes_to_close
      FROM mkt JOIN fc ON mkt.event_id = fc.event_id)
SELECT ticker, event_id, threshold_value, yes_ask_cents, no_ask_cents, forecast_value, minutes_to_close,
  CASE WHEN threshold_value IS NULL THEN 'no_threshold_match'
       WHEN volume < 25 THEN 'volume_too_low'
       WHEN open_interest < 25 THEN 'open_interest_too_low'
       WHEN yes_ask_cents IS NULL OR no_ask_cents IS NULL THEN 'no_two_sided_book'
       WHEN no_ask_cents - (100 - yes_ask_cents) > 10 THEN 'spread_too_wide'
       WHEN NOT (yes_ask_cents BETWEEN 20 AND 80) THEN 'yes_ask_outside_bounds'
       WHEN yes_ask_cents > 75 THEN 'entry_too_expensive'
       WHEN minutes_to_close IS NOT NULL AND minutes_to_close < 30 THEN 'too_close_to_close'
       WHEN minutes_to_close IS NOT NULL AND minutes_to_close > 10080 THEN 'too_far_from_close'
       WHEN forecast_value IS NOT NULL AND minutes_to_close IS NOT NULL AND minutes_to_close < 240.0
            AND abs(threshold_value - forecast_value) <= 25.0 THEN 'basis_risk_zone'
       ELSE 'ok' END AS reason_code
FROM v
""")
def validate_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validator over every market: forecast = mean strike of the event, minutes to close
    from the market size (20 ... 12270 minutes), basis window 25 (price scale of the stand-in)."""
    m = sd.markets(spark, sf_dir)
    fc = m.groupBy("event_id").agg(F.avg("threshold_value").alias("forecast_value"))
    m = m.join(fc, "event_id").withColumn(
        "minutes_to_close", ((F.col("size") - 1) * 250 + 20).cast("double"))
    cfg = gates.ValidatorCfg(basis_risk_strike_window=25.0)
    v = gates.validate_markets(m, cfg)
    return v.select("ticker", "event_id", "threshold_value", "yes_ask_cents", "no_ask_cents",
                    "forecast_value", "minutes_to_close", "reason_code")
