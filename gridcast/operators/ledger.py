"""Position ledger as pure DataFrame transformations.

A cycle takes the current ledger tables and returns new versions; nothing is mutated in
place. Order inside a cycle matters (settle, hedge, then admit) and is the caller's plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import blank_to_null, falsy_num_to_null, num, pnl_cents, side_exit_cents
from gridcast.operators.timeseries import latest_per_key


@dataclass(frozen=True)
class RiskCaps:
    # fixed values: simulator risk caps and hedge thresholds of the reference configuration
    max_open_positions: int = 1
    max_total_exposure_cents: int = 200
    max_bets_per_day: int = 5
    hedge_profit_lock_cents: int = 20
    hedge_stop_loss_cents: int = 15


def open_positions(positions: DataFrame, ticker: str | None = None) -> DataFrame:
    """Open rows, optionally for one ticker (P9). Parquet pushes both predicates down."""
    p = positions.where(F.col("status") == "open")
    return p.where(F.col("ticker") == ticker) if ticker is not None else p


def open_exposure(positions: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """Open exposure and open count per portfolio (A10); portfolios with none get 0."""
    is_open = F.col("status") == "open"
    return positions.groupBy(portfolio).agg(
        F.coalesce(F.sum(F.when(is_open, F.col("entry_price_cents") * F.col("contracts"))),
                   F.lit(0)).cast("bigint").alias("exposure_cents"),
        F.count_if(is_open).cast("bigint").alias("n_open"))


def entries_on_day(trades: DataFrame, as_of: Column, portfolio: str = "portfolio") -> DataFrame:
    """Entry trades created on the as-of UTC day, per portfolio."""
    hit = (F.col("kind") == "entry") & (F.to_date(F.col("created_at")) == as_of)
    return trades.groupBy(portfolio).agg(F.count_if(hit).cast("bigint").alias("n_entries"))


def latest_status(status: DataFrame, order_cols=("ts",)) -> DataFrame:
    """Latest status row per ticker (S9, A9), for all tickers at once."""
    return latest_per_key(status, ["ticker"], list(order_cols))


def settlements(positions: DataFrame, status: DataFrame) -> DataFrame:
    """Exit prices for open positions whose market has resolved.

    Skip markets still open / active. Settle text = yes_settled_price where
    present and non-zero, else settlement_value where present (0 settles at 0); it must parse (else skip), and is rounded
    half-even. Without one: result yes -> 100, no -> 0, otherwise the position stays open.
    """
    p = open_positions(positions)
    j = p.join(status.select("ticker", "status", "yes_settled_price", "settlement_value", "result")
               .withColumnRenamed("status", "mkt_status"), "ticker")
    settle_txt = F.coalesce(falsy_num_to_null("yes_settled_price"), blank_to_null("settlement_value"))
    res = F.lower(F.coalesce(F.col("result"), F.lit("")))
    settle = (F.when(settle_txt.isNotNull(), F.bround(num(settle_txt), 0).cast("int"))
              .when(res == "yes", F.lit(100)).when(res == "no", F.lit(0)))
    j = j.where(~F.coalesce("mkt_status", F.lit("")).isin("open", "active")).withColumn("_settle", settle)
    j = j.where(F.col("_settle").isNotNull())
    ex = side_exit_cents("side", "_settle")
    return j.select("portfolio", "id", "ticker", "side", "entry_price_cents", "contracts",
                    ex.alias("exit_price_cents"),
                    pnl_cents(ex, F.col("entry_price_cents"), F.col("contracts")).alias("realized_pnl_cents"),
                    F.lit("settle").alias("close_reason"))


def hedge_triggers(positions: DataFrame, quotes: DataFrame, caps: RiskCaps = RiskCaps()) -> DataFrame:
    """Profit-lock / stop-loss closes (B5, J6, F17): open, not yet hedged, decision without
    'hedge'; current ask of the held side minus entry >= +lock or <= -stop. A missing ask
    on that side skips the position."""
    p = open_positions(positions).where(
        F.col("hedge_id").isNull() & ~F.coalesce(F.col("decision_json"), F.lit("")).contains("hedge"))
    j = p.join(quotes.select("ticker", "yes_ask_cents", "no_ask_cents"), "ticker")
    ask = F.when(F.col("side") == "YES", F.col("yes_ask_cents")).otherwise(F.col("no_ask_cents"))
    j = j.withColumn("_ask", ask).where(F.col("_ask").isNotNull())
    delta = (F.col("_ask") - F.col("entry_price_cents")).cast("int")
    j = j.withColumn("delta_cents", delta).where(
        (F.col("delta_cents") >= caps.hedge_profit_lock_cents)
        | (F.col("delta_cents") <= -caps.hedge_stop_loss_cents))
    return j.select("portfolio", "id", "ticker", "side", "entry_price_cents", "contracts",
                    F.col("_ask").cast("int").alias("exit_price_cents"), "delta_cents",
                    pnl_cents(F.col("_ask"), F.col("entry_price_cents"), F.col("contracts"))
                    .alias("realized_pnl_cents"),
                    F.when(F.col("delta_cents") >= 0, "profit_lock").otherwise("stop_loss")
                    .alias("close_reason"))


def close_positions(positions: DataFrame, closings: DataFrame, as_of_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Apply closings (B4, K5): matching open rows become closed with exit price, time and P&L;
    hedge closes also stamp ``hedge_id = id``. Already-closed rows are untouched. Returns the
    new positions table and the exit trades to append."""
    c = closings.select("id", F.col("exit_price_cents").alias("_x"), F.col("close_reason").alias("_why"))
    j = positions.join(c, "id", "left")
    hit = (F.col("status") == "open") & F.col("_x").isNotNull()
    new = j.select(
        *[F.when(hit, F.lit("closed")).otherwise(F.col("status")).alias("status") if x == "status"
          else F.col(x) for x in positions.columns if x not in ("exit_price_cents", "exited_at",
                                                                  "realized_pnl_cents", "hedge_id")],
        F.when(hit, F.col("_x")).otherwise(F.col("exit_price_cents") if "exit_price_cents" in positions.columns
                                           else F.lit(None)).cast("int").alias("exit_price_cents"),
        F.when(hit, as_of_ts).otherwise(F.col("exited_at") if "exited_at" in positions.columns
                                        else F.lit(None)).alias("exited_at"),
        F.when(hit, pnl_cents(F.col("_x"), F.col("entry_price_cents"), F.col("contracts")))
        .otherwise(F.col("realized_pnl_cents") if "realized_pnl_cents" in positions.columns
                   else F.lit(None)).cast("int").alias("realized_pnl_cents"),
        F.when(hit & F.col("_why").isin("profit_lock", "stop_loss"), F.col("id"))
        .otherwise(F.col("hedge_id")).alias("hedge_id"))
    exits = j.where(hit).select("portfolio", F.col("id").alias("position_id"), "ticker", "side",
                                F.lit("sell").alias("action"), F.col("_x").cast("int").alias("price_cents"),
                                "contracts", as_of_ts.alias("created_at"), F.lit("exit").alias("kind"))
    return new, exits


def eligibility(candidates: DataFrame, positions: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """Ticker gates of admission (J9, B7): a ticker with an open position, or with any closed
    position, is refused. Position flags are reduced per (portfolio, ticker) first, so the join
    is one row per ticker whatever the ledger size."""
    flags = positions.groupBy(portfolio, "ticker").agg(
        F.max((F.col("status") == "open").cast("int")).alias("_has_open"),
        F.max((F.col("status") == "closed").cast("int")).alias("_has_closed"))
    j = candidates.join(flags, [portfolio, "ticker"], "left")
    why = (F.when(F.col("_has_open") == 1, "already_have_open_position")
           .when(F.col("_has_closed") == 1, "already_traded_this_ticker").otherwise("ok"))
    return j.withColumn("eligibility", why).drop("_has_open", "_has_closed")


def capped_admission(candidates: DataFrame, state: DataFrame, caps: RiskCaps = RiskCaps(),
                     portfolio: str = "portfolio", prio: str = "prio",
                     cost: str = "ask_cents") -> DataFrame:
    """Order-dependent admission under caps (B2), exactly as a sequential pass would decide.

    Candidates are visited in (``prio``, ticker, cost) order per portfolio; a refused candidate uses no
    capacity, and of equal candidates the first counts. Because state only changes when a candidate is admitted and the caps bound the
    number of admissions per portfolio by R = min(max_open, max_bets_per_day), the pass equals
    R rounds of: "first candidate after the last admitted one that passes every gate under the
    current state" - a ``min_by`` aggregation per portfolio (partial aggregation: a portfolio
    holding a third of all candidates is reduced map-side, never collected into one task).

    ``candidates``: portfolio, ticker, prio, ask_cents, eligibility ('ok' or a refusal).
    ``state``: portfolio, n_open, exposure_cents, n_entries (current ledger, per portfolio).
    Returns the admitted candidates with their admission round.
    """
    from gridcast.session import cut_lineage

    rounds = min(caps.max_open_positions, caps.max_bets_per_day)
    order = F.struct(prio, "ticker", cost)
    cand = candidates.where((F.col("eligibility") == "ok") & (F.col(cost) > 0) & (F.col(cost) < 100))
    cand = cut_lineage(cand.select(portfolio, "ticker", prio, cost))
    st = state.select(portfolio, F.col("n_open").cast("bigint").alias("_n"),
                      F.col("exposure_cents").cast("bigint").alias("_x"),
                      F.col("n_entries").cast("bigint").alias("_b"),
                      F.lit(None).cast(cand.select(order.alias("o")).schema["o"].dataType).alias("_last"))
    admitted = None
    for r in range(rounds):
        taken = (admitted.select(portfolio, "ticker") if admitted is not None else None)
        c = cand.join(st, portfolio, "left").fillna(0, subset=["_n", "_x", "_b"])
        c = c.where((F.col("_last").isNull() | (order > F.col("_last")))
                    & (F.col("_n") < caps.max_open_positions)
                    & (F.col("_x") + F.col(cost) <= caps.max_total_exposure_cents)
                    & (F.col("_b") < caps.max_bets_per_day))
        if taken is not None:
            c = c.join(taken, [portfolio, "ticker"], "left_anti")
        pick = c.groupBy(portfolio).agg(F.min_by(F.struct("ticker", prio, cost), order).alias("_p"))
        pick = pick.select(portfolio, F.col("_p.ticker").alias("ticker"), F.col(f"_p.{prio}").alias(prio),
                           F.col(f"_p.{cost}").alias(cost), F.lit(r + 1).alias("round"))
        pick = cut_lineage(pick)
        admitted = pick if admitted is None else admitted.unionByName(pick)
        upd = pick.select(portfolio, F.col(cost).alias("_add"), order.alias("_p"))
        st = (st.join(upd, portfolio, "full_outer")
              .select(portfolio,
                      (F.coalesce("_n", F.lit(0)) + F.when(F.col("_add").isNotNull(), 1).otherwise(0)).alias("_n"),
                      (F.coalesce("_x", F.lit(0)) + F.coalesce("_add", F.lit(0))).alias("_x"),
                      (F.coalesce("_b", F.lit(0)) + F.when(F.col("_add").isNotNull(), 1).otherwise(0)).alias("_b"),
                      F.coalesce("_p", "_last").alias("_last")))
        st = cut_lineage(st)
    return admitted


def open_rows(admitted: DataFrame, as_of_ts: Column, side: str = "side",
              cost: str = "ask_cents") -> tuple[DataFrame, DataFrame]:
    """New open positions (1 contract) and entry trades for admitted candidates."""
    meta = [c for c in admitted.columns if c not in ("portfolio",)]
    pos = admitted.select("portfolio", "ticker", F.col(side).alias("side"),
                          F.col(cost).cast("int").alias("entry_price_cents"), F.lit(1).alias("contracts"),
                          as_of_ts.alias("opened_at"), F.lit("open").alias("status"),
                          F.to_json(F.struct(*[F.col(c) for c in meta])).alias("decision_json"))
    trd = admitted.select("portfolio", "ticker", F.col(side).alias("side"), F.lit("buy").alias("action"),
                          F.col(cost).cast("int").alias("price_cents"), F.lit(1).alias("contracts"),
                          as_of_ts.alias("created_at"), F.lit("entry").alias("kind"))
    return pos, trd


def admission_reasons(candidates: DataFrame, state: DataFrame, admitted: DataFrame,
                      caps: RiskCaps = RiskCaps(), portfolio: str = "portfolio", prio: str = "prio",
                      cost: str = "ask_cents") -> DataFrame:
    """Reason for every candidate of a capped-admission pass (B2): the state a candidate sees
    is the initial state plus the admissions before it (at most R per portfolio, so the join
    to the admitted rows expands each candidate by at most R), then the gates in the
    reference's order: open position (incl. one opened earlier in this cycle), traded ticker,
    open count, exposure, daily count, invalid ask. Every candidate gets a row: of repeated ones
    the first is answered as if alone, the others see its admission, if it had one."""
    adm = admitted.select(portfolio, F.col("ticker").alias("_at"), F.col(prio).alias("_ap"),
                          F.col(cost).alias("_ac"))
    rows = [portfolio, "ticker", prio, cost, "eligibility"]
    same = candidates.groupBy(*rows).agg(F.count(F.lit(1)).alias("_copies"))
    c = same.join(adm, portfolio, "left")
    here = F.struct(F.col(prio).alias("_ap"), F.col("ticker").alias("_at"), F.col(cost).alias("_ac"))
    # a portfolio without admissions has one joined row, all null, and that row is no admission
    before = F.col("_at").isNotNull() & (F.struct("_ap", "_at", "_ac") < here)
    agg = c.groupBy(*rows, "_copies").agg(
        F.count_if(before).alias("_k"), F.coalesce(F.sum(F.when(before, F.col("_ac"))), F.lit(0)).alias("_kx"),
        F.max((before & (F.col("_at") == F.col("ticker"))).cast("int")).alias("_taken"),
        F.max((F.col("_at").isNotNull() & F.struct("_ap", "_at", "_ac").eqNullSafe(here)
               & (F.col("eligibility") == "ok")).cast("int")).alias("_me"))
    st = state.select(portfolio, F.col("n_open").alias("_n0"), F.col("exposure_cents").alias("_x0"),
                      F.col("n_entries").alias("_b0"))
    j = agg.join(st, portfolio, "left").fillna(0, subset=["_n0", "_x0", "_b0"])
    n = F.col("_n0") + F.col("_k")
    x = F.col("_x0") + F.col("_kx")
    b = F.col("_b0") + F.col("_k")
    why = (F.when(F.col("_me") == 1, "ok")
           .when((F.col("eligibility") == "already_have_open_position") | (F.col("_taken") == 1),
                 "already_have_open_position")
           .when(F.col("eligibility") != "ok", F.col("eligibility"))
           .when(n >= caps.max_open_positions, "max_open_positions")
           .when(x + F.col(cost) > caps.max_total_exposure_cents, "max_total_exposure")
           .when(b >= caps.max_bets_per_day, "max_bets_per_day")
           .when(F.col(cost).isNull() | (F.col(cost) <= 0) | (F.col(cost) >= 100), "invalid_ask")
           .otherwise("ok"))
    j = j.select(portfolio, "ticker", prio, cost, "_me", why.alias("_why"),
                 F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return j.select(portfolio, "ticker", prio, cost,
                    F.when((F.col("_me") == 1) & (F.col("_copy") > 1), "already_have_open_position")
                    .otherwise(F.col("_why")).alias("reason"))
