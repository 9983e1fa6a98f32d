"""Quote operators: price chain, per-series snapshot, implied level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import price_prob, quote_volume


def priced_quotes(raw: DataFrame) -> DataFrame:
    """Typed quote rows: probability from the price chain and integer volume."""
    return raw.select(
        "*",
        price_prob("yes_ask", "yes_ask_dollars", "last_price_dollars", "yes_bid_dollars").alias("prob"),
        quote_volume("volume", "volume_fp").alias("volume_int"),
    )


def series_snapshot(quotes: DataFrame, series_dim: DataFrame, series: str = "series_ticker",
                    label: str = "label", open_status: str = "open") -> DataFrame:
    """Per-label snapshot of open markets (A7): count, volume sum, mean and max probability.

    Quotes are reduced per series first (partial aggregation, so a hot series is combined
    map-side), then the small series dimension is left-joined so labels without open markets
    stay with n_open = 0, vol_sum = 0 and NULL probabilities.
    """
    q = priced_quotes(quotes).where(F.col("status") == open_status)
    agg = q.groupBy(series).agg(F.count(F.lit(1)).alias("n_open"),
                                F.sum("volume_int").alias("vol_sum"),
                                F.avg("prob").alias("avg_prob"), F.max("prob").alias("max_prob"))
    j = series_dim.join(agg, series, "left")
    return j.select(label, F.coalesce("n_open", F.lit(0)).cast("bigint").alias("n_open"),
                    F.coalesce("vol_sum", F.lit(0)).cast("bigint").alias("vol_sum"),
                    "avg_prob", "max_prob")


def snapshot_wide(snapshot: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """One row with ``xk_<label>_<stat>`` columns (pivot over a known label list)."""
    stats = ["n_open", "vol_sum", "avg_prob", "max_prob"]
    piv = snapshot.groupBy().pivot(label, list(labels)).agg(*[F.first(s).alias(s) for s in stats])
    return piv.select(*[F.col(f"{lb}_{s}").alias(f"xk_{lb}_{s}") for lb in labels for s in stats])


def implied_level(markets: DataFrame, group: Sequence[str], strike: str = "threshold_value",
                  ask: str = "yes_ask_cents", tiebreak: str = "ticker",
                  level: float = 50.0, max_rows_per_task: int = 1_000_000) -> DataFrame:
    """Strike where the YES ask curve crosses 50 cents, per group.

    Priced strikes are sorted by (strike, tiebreak); the first adjacent pair with
    lo_ask >= 50 >= hi_ask is interpolated linearly (zero span -> lower strike). Without a
    bracket: the lowest strike if its ask is below 50, else the highest strike if its ask is
    above 50, else NULL. Fewer than two priced strikes -> NULL.
    Adjacent pairs come from ``bucketed_lead`` (a hot event is scanned by many tasks); the
    first bracket and the ends are ``min_by`` / ``max_by`` aggregates on the sort key.
    """
    from gridcast.operators.ordered import bucketed_lead

    m = markets.where(F.col(strike).isNotNull() & F.col(ask).isNotNull()).select(
        *group, F.col(strike).alias("_k"), F.col(ask).cast("double").alias("_a"), F.col(tiebreak).alias("_t"))
    s = bucketed_lead(m, group, "_k", ["_t"], ["_a"], max_rows_per_task, prefix="_n")
    hit = (F.col("_a") >= level) & (F.col("_n_a") <= level)
    span = F.col("_a") - F.col("_n_a")
    cross = F.when(span <= 0, F.col("_k")).otherwise(
        F.col("_k") + (F.col("_a") - level) / span * (F.col("_n_k") - F.col("_k")))
    order = F.struct("_k", "_t")
    g = s.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_strikes"),
        F.min_by(F.when(hit, cross), F.when(hit, order)).alias("_x"),
        F.min_by(F.struct("_k", "_a"), order).alias("_lo"),
        F.max_by(F.struct("_k", "_a"), order).alias("_hi"))
    lvl = (F.when(F.col("n_strikes") < 2, F.lit(None).cast("double"))
           .when(F.col("_x").isNotNull(), F.col("_x"))
           .when(F.col("_lo._a") < level, F.col("_lo._k"))
           .when(F.col("_hi._a") > level, F.col("_hi._k")))
    return g.select(*group, lvl.alias("implied_level"), "n_strikes")
