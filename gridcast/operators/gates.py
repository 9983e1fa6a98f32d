"""Signal and validator gates as ordered ``when`` chains.

Each row gets exactly one decision and the code of the first gate that failed. Human-readable
reasons are formatted only at a sink (``reason_text``): formatting rules for halves differ
between engines, so the data path carries codes and numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import implied_prob


@dataclass(frozen=True)
class SignalCfg:
    # fixed values: signal gate defaults of the reference configuration
    min_edge: float = 0.05
    min_volume: int = 25
    min_open_interest: int = 25
    max_spread_cents: int = 10
    max_entry_price_cents: int = 75


@dataclass(frozen=True)
class ValidatorCfg:
    # fixed values: validator defaults of the reference's daily job configuration
    min_volume: int = 25
    min_open_interest: int = 25
    max_spread_cents: int = 10
    prob_low_cents: int = 20
    prob_high_cents: int = 80
    max_entry_price_cents: int = 75
    min_minutes_to_close: int = 30
    max_minutes_to_close: int = 60 * 24 * 7
    basis_risk_strike_window: float = 0.05
    basis_risk_max_hours_to_close: float = 4.0


def _p(df: DataFrame, name: str, default) -> Column:
    """Gate threshold: a column of that name on the rows (e.g. joined from a per-series config
    table) wins over the configured literal."""
    return F.col(name) if name in df.columns else F.lit(default)


def spread(yes: Column, no: Column) -> Column:
    """no_ask - (100 - yes_ask); NULL when a side is missing."""
    return (no - (F.lit(100) - yes)).cast("int")


def compute_signals(markets: DataFrame, probs: DataFrame, on: list[str],
                    cfg: SignalCfg = SignalCfg(), prob_col: str = "prob") -> DataFrame:
    """Markets scored against model probabilities.

    Left equi-join on the strike key; no match -> NO_TRADE / no_threshold_match with zero
    probabilities, zero edge and NULL spread. Then the first failing gate in order: volume,
    open interest, spread, edge >= m (YES price cap) -> BUY_YES, edge <= -m (NO price cap)
    -> BUY_NO, else insufficient edge.
    """
    j = markets.join(probs.select(*on, F.col(prob_col).alias("_mp")), on, "left")
    yes, no = F.col("yes_ask_cents"), F.col("no_ask_cents")
    matched = F.col("_mp").isNotNull() & F.col("threshold_value").isNotNull()
    kp = F.coalesce(implied_prob(yes), F.lit(0.0))
    edge = F.col("_mp") - kp
    sp = spread(yes, no)
    j = j.select("*", matched.alias("_m"), edge.alias("_e"), sp.alias("_s"), kp.alias("_kp"))
    e, s = F.col("_e"), F.col("_s")
    m = _p(markets, "min_edge", cfg.min_edge)
    cap = _p(markets, "max_entry_price_cents", cfg.max_entry_price_cents)
    code = (F.when(~F.col("_m"), "no_threshold_match")
            .when(F.coalesce("volume", F.lit(0)) < _p(markets, "min_volume", cfg.min_volume), "volume_too_low")
            .when(F.coalesce("open_interest", F.lit(0)) < _p(markets, "min_open_interest", cfg.min_open_interest),
                  "open_interest_too_low")
            .when(s.isNotNull() & (s > _p(markets, "max_spread_cents", cfg.max_spread_cents)), "spread_too_wide")
            .when((e >= m) & yes.isNotNull() & (yes > cap), "entry_too_expensive_yes")
            .when(e >= m, "edge_yes")
            .when((e <= -m) & no.isNotNull() & (no > cap), "entry_too_expensive_no")
            .when(e <= -m, "edge_no")
            .otherwise("insufficient_edge"))
    decision = (F.when(F.col("reason_code") == "edge_yes", "BUY_YES")
                .when(F.col("reason_code") == "edge_no", "BUY_NO").otherwise("NO_TRADE"))
    out = j.withColumn("reason_code", code).withColumn("decision", decision)
    keep = [c for c in markets.columns]
    return out.select(
        *keep,
        F.when(F.col("_m"), F.col("_mp")).otherwise(0.0).alias("model_prob"),
        F.when(F.col("_m"), F.col("_kp")).otherwise(0.0).alias("market_implied_prob"),
        F.when(F.col("_m"), F.col("_e")).otherwise(0.0).alias("edge"),
        F.when(F.col("_m"), F.col("_s")).alias("spread_cents"),
        "decision", "reason_code")


def validate_markets(markets: DataFrame, cfg: ValidatorCfg = ValidatorCfg(),
                     forecast: str = "forecast_value",
                     minutes_to_close: str = "minutes_to_close", side_aware: bool = False) -> DataFrame:
    """First-fail validator (G4): (ok, reason_code). Time gates only when minutes_to_close is
    known; the basis-risk zone needs both forecast and minutes_to_close. By default the YES ask
    is checked for the price band and entry cap whatever the side (as the reference does);
    ``side_aware=True`` checks the ask of the side a ``decision`` column says is bought (D9)."""
    yes, no = F.col("yes_ask_cents"), F.col("no_ask_cents")
    band = yes
    if side_aware:
        band = F.when(F.col("decision") == "BUY_NO", no).otherwise(yes)
    mtc, f, k = F.col(minutes_to_close), F.col(forecast), F.col("threshold_value")
    sp = no - (F.lit(100) - yes)
    basis_on = cfg.basis_risk_strike_window > 0 and cfg.basis_risk_max_hours_to_close > 0
    basis = (f.isNotNull() & mtc.isNotNull() & (mtc < cfg.basis_risk_max_hours_to_close * 60)
             & (F.abs(k - f) <= cfg.basis_risk_strike_window)) if basis_on else F.lit(False)
    code = (F.when(k.isNull(), "no_threshold_match")
            .when(F.coalesce("volume", F.lit(0)) < cfg.min_volume, "volume_too_low")
            .when(F.coalesce("open_interest", F.lit(0)) < cfg.min_open_interest, "open_interest_too_low")
            .when(yes.isNull() | no.isNull(), "no_two_sided_book")
            .when(sp > cfg.max_spread_cents, "spread_too_wide")
            .when(~band.between(cfg.prob_low_cents, cfg.prob_high_cents), "yes_ask_outside_bounds")
            .when(band > cfg.max_entry_price_cents, "entry_too_expensive")
            .when(mtc.isNotNull() & (mtc < cfg.min_minutes_to_close), "too_close_to_close")
            .when(mtc.isNotNull() & (mtc > cfg.max_minutes_to_close), "too_far_from_close")
            .when(basis, "basis_risk_zone")
            .otherwise("ok"))
    return markets.withColumn("reason_code", code).withColumn("ok", F.col("reason_code") == "ok")


def gate_audit(signals: DataFrame) -> DataFrame:
    """Rejections (and trades) counted by decision and first failing gate."""
    return signals.groupBy("decision", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def ask_for_side(decision: Column, yes: Column, no: Column) -> Column:
    """Ask paid for the side a BUY decision takes (B1); NULL for NO_TRADE."""
    return F.when(decision == "BUY_YES", yes).when(decision == "BUY_NO", no)


def market_views(signals: DataFrame) -> DataFrame:
    """Market-view rows (K7): verdict, edge split into YES / NO halves."""
    return signals.select(
        "ticker", "threshold_value", "model_prob", "yes_ask_cents", "no_ask_cents", "spread_cents",
        F.when(F.col("edge") >= 0, F.col("edge")).alias("edge_yes"),
        F.when(F.col("edge") < 0, -F.col("edge")).alias("edge_no"),
        F.when(F.col("decision").isin("BUY_YES", "BUY_NO"), F.col("decision")).otherwise("SKIP")
        .alias("verdict"),
        F.col("reason_code").alias("rejection_reason"), "volume", "open_interest",
        ask_for_side(F.col("decision"), F.col("yes_ask_cents"), F.col("no_ask_cents"))
        .alias("side_ask_cents"))


def reason_text(df: DataFrame, cfg: SignalCfg = SignalCfg()) -> Column:
    """Human-readable reason for sinks (F13), e.g. ``volume_too_low (3<25)``."""
    rc = F.col("reason_code")
    return (F.when(rc == "volume_too_low", F.format_string("volume_too_low (%d<%d)", F.col("volume"), F.lit(cfg.min_volume)))
            .when(rc == "open_interest_too_low", F.format_string("open_interest_too_low (%d<%d)", F.col("open_interest"), F.lit(cfg.min_open_interest)))
            .when(rc == "spread_too_wide", F.format_string("spread_too_wide (%dc>%dc)", F.col("spread_cents"), F.lit(cfg.max_spread_cents)))
            .when(rc == "entry_too_expensive_yes", F.format_string("entry_too_expensive_yes (%dc>%dc)", F.col("yes_ask_cents"), F.lit(cfg.max_entry_price_cents)))
            .when(rc == "entry_too_expensive_no", F.format_string("entry_too_expensive_no (%dc>%dc)", F.col("no_ask_cents"), F.lit(cfg.max_entry_price_cents)))
            .when(rc == "edge_yes", F.format_string("edge_yes=%+.3f", F.col("edge")))
            .when(rc == "edge_no", F.format_string("edge_no=%+.3f", F.col("edge")))
            .when(rc == "insufficient_edge", F.format_string("insufficient_edge (%+.3f)", F.col("edge")))
            .otherwise(rc))
