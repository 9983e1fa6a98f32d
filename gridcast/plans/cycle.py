"""Daily ledger cycle as one function over DataFrames (entry 3 of the reference job):
settle resolved markets, close hedge triggers, then admit new BUY signals under the caps.
Order matters: closings free capacity before admission. Returns new table versions; the
caller writes them (sinks.writers.write_positions_version / append_trades)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators import ledger


@dataclass
class CycleResult:
    positions: DataFrame
    trades: DataFrame
    closings: DataFrame
    admitted: DataFrame


def run_cycle(positions: DataFrame, trades: DataFrame, quotes: DataFrame, statuses: DataFrame,
              signals: DataFrame, as_of_day: Column, as_of_ts: Column,
              caps: ledger.RiskCaps = ledger.RiskCaps()) -> CycleResult:
    """``signals``: portfolio, ticker, decision, yes_ask_cents, no_ask_cents, prio (signal
    order). ``positions`` must carry id, portfolio, ticker, side, entry_price_cents, contracts,
    status, hedge_id, decision_json, exit_price_cents, exited_at, realized_pnl_cents."""
    settle = ledger.settlements(positions, ledger.latest_status(statuses))
    p1, ex1 = ledger.close_positions(positions, settle, as_of_ts)
    hedge = ledger.hedge_triggers(p1, quotes, caps)
    p2, ex2 = ledger.close_positions(p1, hedge, as_of_ts)
    buys = signals.where(F.col("decision").isin("BUY_YES", "BUY_NO")).select(
        "portfolio", "ticker", "prio",
        F.when(F.col("decision") == "BUY_YES", "YES").otherwise("NO").alias("side"),
        F.when(F.col("decision") == "BUY_YES", F.col("yes_ask_cents")).otherwise(F.col("no_ask_cents"))
        .cast("int").alias("ask_cents")).where(F.col("ask_cents").isNotNull())
    cand = ledger.eligibility(buys, p2)
    state = ledger.open_exposure(p2).join(
        ledger.entries_on_day(trades, as_of_day), "portfolio", "full_outer").fillna(0)
    admitted = ledger.capped_admission(cand, state, caps)
    admitted = admitted.join(cand.select("portfolio", "ticker", "prio", "side"), ["portfolio", "ticker", "prio"])
    new_pos, _ = ledger.open_rows(admitted, as_of_ts)
    # new ids continue the ledger's id sequence: one scalar from an aggregate, then a row
    # number over the admitted rows (at most caps x portfolios rows)
    from pyspark.sql import Window
    base = p2.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new_pos = new_pos.withColumn("id", F.lit(int(base)) + F.row_number().over(
        Window.orderBy("portfolio", "ticker")).cast("long"))
    entries = new_pos.select("portfolio", F.col("id").alias("position_id"), "ticker", "side",
                             F.lit("buy").alias("action"), F.col("entry_price_cents").alias("price_cents"),
                             "contracts", F.col("opened_at").alias("created_at"), F.lit("entry").alias("kind"))
    positions_out = p2.unionByName(new_pos, allowMissingColumns=True)
    trades_out = trades.unionByName(ex1, allowMissingColumns=True).unionByName(
        ex2, allowMissingColumns=True).unionByName(entries, allowMissingColumns=True)
    return CycleResult(positions_out, trades_out, settle.unionByName(hedge, allowMissingColumns=True), admitted)
