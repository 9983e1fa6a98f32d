import datetime as dt
import random

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcast.operators import ledger
from gridcast.operators import metrics as mx

POS = ("portfolio string, id bigint, ticker string, side string, entry_price_cents int, contracts int, "
       "status string, hedge_id bigint, decision_json string")


def test_settlement_rules(spark):
    pos = spark.createDataFrame([
        ("p", 1, "A", "YES", 42, 1, "open", None, None), ("p", 2, "B", "NO", 30, 1, "open", None, None),
        ("p", 3, "C", "YES", 50, 1, "open", None, None), ("p", 4, "D", "YES", 50, 1, "open", None, None),
        ("p", 5, "E", "YES", 50, 1, "closed", None, None), ("p", 6, "F", "YES", 50, 1, "open", None, None)], POS)
    stt = spark.createDataFrame([
        ("A", "settled", "100", None, None), ("B", "finalized", "0", None, "no"),
        ("C", "settled", None, None, None), ("D", "open", "100", None, "yes"),
        ("E", "settled", "100", None, None), ("F", "settled", None, "62.5", None)],
        "ticker string, status string, yes_settled_price string, settlement_value string, result string")
    got = {r["id"]: (r["exit_price_cents"], r["realized_pnl_cents"]) for r in ledger.settlements(pos, stt).collect()}
    # smoke lifecycle: YES at 42 settled 100 -> +58; NO side settles 100 - 0; unresolved/open/closed skipped;
    # 62.5 rounds half-even to 62
    assert got == {1: (100, 58), 2: (100, 70), 6: (62, 12)}


def test_hedge_thresholds(spark):
    pos = spark.createDataFrame([
        ("p", 1, "A", "YES", 40, 1, "open", None, None), ("p", 2, "B", "YES", 40, 1, "open", None, None),
        ("p", 3, "C", "YES", 40, 1, "open", None, None), ("p", 4, "D", "YES", 40, 1, "open", None, None),
        ("p", 5, "E", "NO", 40, 1, "open", None, None), ("p", 6, "F", "YES", 40, 1, "open", 6, None),
        ("p", 7, "G", "YES", 40, 1, "open", None, '{"hedge": 1}'), ("p", 8, "H", "NO", 40, 1, "open", None, None)], POS)
    q = spark.createDataFrame([("A", 59, 1), ("B", 60, 1), ("C", 26, 1), ("D", 25, 1), ("E", 1, 60),
                               ("F", 90, 1), ("G", 90, 1), ("H", 90, None)],
                              "ticker string, yes_ask_cents int, no_ask_cents int")
    got = {r["id"]: r["close_reason"] for r in ledger.hedge_triggers(pos, q).collect()}
    assert got == {2: "profit_lock", 4: "stop_loss", 5: "profit_lock"}


def test_close_positions_updates_and_exits(spark):
    pos = spark.createDataFrame([("p", 1, "A", "YES", 42, 1, "open", None, None),
                                 ("p", 2, "B", "YES", 42, 1, "closed", None, None)], POS)
    closings = spark.createDataFrame([(1, 100, "settle"), (2, 100, "settle")],
                                     "id bigint, exit_price_cents int, close_reason string")
    new, exits = ledger.close_positions(pos, closings, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    got = {r["id"]: (r["status"], r["exit_price_cents"], r["realized_pnl_cents"]) for r in new.collect()}
    assert got == {1: ("closed", 100, 58), 2: ("closed", None, None)}
    assert exits.count() == 1


def _fold_ref(cands, caps):
    n_open, exp, bets, out, taken = 0, 0, 0, [], set()
    for prio, ticker, ask in sorted(cands):
        if ticker in taken or n_open >= caps.max_open_positions:
            continue
        if exp + ask > caps.max_total_exposure_cents or bets >= caps.max_bets_per_day:
            continue
        if ask <= 0 or ask >= 100:
            continue
        taken.add(ticker)
        n_open, exp, bets = n_open + 1, exp + ask, bets + 1
        out.append((prio, ticker, ask))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), min_size=1, max_size=25),
       st.integers(1, 4), st.integers(50, 250))
def test_capped_admission_matches_sequential_fold(spark, raw, max_open, max_exp):
    caps = ledger.RiskCaps(max_open_positions=max_open, max_total_exposure_cents=max_exp, max_bets_per_day=3)
    cands = [(i, f"T{t}", a) for i, (t, a) in enumerate(raw)]
    df = spark.createDataFrame([("p", t, i, a, "ok") for i, t, a in cands],
                               "portfolio string, ticker string, prio bigint, ask_cents int, eligibility string")
    state = spark.createDataFrame([("p", 0, 0, 0)], "portfolio string, n_open int, exposure_cents int, n_entries int")
    got = sorted((r["prio"], r["ticker"], r["ask_cents"]) for r in ledger.capped_admission(df, state, caps).collect())
    assert got == _fold_ref(cands, caps)


def test_auc_ties_against_pairs(spark):
    rnd = random.Random(3)
    data = [("t", i, rnd.choice([0.1, 0.2, 0.2, 0.5, 0.7, 0.9]), rnd.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(data, "threshold string, row_id int, predicted_prob double, actual_label int")
    r = mx.binary_metrics(df, ["threshold"]).collect()[0]
    pos = [p for _, _, p, y in data if y == 1]
    neg = [p for _, _, p, y in data if y == 0]
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(r["roc_auc"] - auc) < 1e-12
    tp = sum(1 for _, _, p, y in data if p >= 0.5 and y == 1)
    fp = sum(1 for _, _, p, y in data if p >= 0.5 and y == 0)
    assert abs(r["precision"] - tp / (tp + fp)) < 1e-12


def test_one_class_strike_dropped_and_macro_zero(spark):
    df = spark.createDataFrame([("t", 1, 0.3, 1), ("t", 2, 0.6, 1)],
                               "threshold string, row_id int, predicted_prob double, actual_label int")
    per = mx.binary_metrics(df, ["threshold"])
    assert per.count() == 0
    m = mx.macro_metrics(per).collect()[0]
    assert m["n_strikes"] == 0 and m["avg_accuracy"] == 0.0


def test_walk_forward_matches_timeseriessplit_rule(spark):
    n, k = 23, 5
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("s", d0 + dt.timedelta(days=i)) for i in range(n)], "series_id string, date date")
    got = {(r["fold"], r["role"]): 0 for r in []}
    for r in mx.walk_forward_folds(df, ["series_id"], k).collect():
        got[(r["fold"], r["role"])] = got.get((r["fold"], r["role"]), 0) + 1
    t = n // (k + 1)
    for i in range(k):
        start = n - (k - i) * t
        assert got[(i, "train")] == start and got[(i, "test")] == t


def test_pairwise_corr_constant_is_null_and_prune(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0, (-1.0) ** i) for i in range(10)],
                               "a double, b double, c double, d double")
    corr = mx.pairwise_corr(df, ["a", "b", "c", "d"])
    got = {(r["f1"], r["f2"]): r["corr"] for r in corr.collect()}
    assert abs(got[("a", "b")] - 1.0) < 1e-12 and got[("a", "c")] is None
    order = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("d", 3)], "feature string, rank int")
    kept = {r["feature"]: r["kept"] for r in mx.greedy_prune(corr, order).collect()}
    assert kept == {"b": True, "a": False, "c": True, "d": True}


def test_robust_spread_floor(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("s", 1.0), ("t", 0.0), ("t", 1.0), ("t", 5.0)],
                               "g string, r double")
    got = {r["g"]: r["residual_std"] for r in mx.robust_spread(df, ["g"], "r").collect()}
    assert got["s"] == 0.05 and abs(got["t"] - 1.4826) < 1e-12


def _fold_reasons(cands, caps):
    n_open, exp, bets, out, taken = 0, 0, 0, [], set()
    for prio, ticker, ask in sorted(cands):
        if ticker in taken:
            why = "already_have_open_position"
        elif n_open >= caps.max_open_positions:
            why = "max_open_positions"
        elif exp + ask > caps.max_total_exposure_cents:
            why = "max_total_exposure"
        elif bets >= caps.max_bets_per_day:
            why = "max_bets_per_day"
        elif ask <= 0 or ask >= 100:
            why = "invalid_ask"
        else:
            why = "ok"
            taken.add(ticker)
            n_open, exp, bets = n_open + 1, exp + ask, bets + 1
        out.append((prio, ticker, ask, why))
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 100)), min_size=1, max_size=20),
       st.integers(1, 4), st.integers(50, 250))
@example([(0, 0, 0)], 1, 50)                                  # no admission at all: an ask of 0
@example([(0, 0, 60)], 1, 50)                                 # and one over the cap
@example([(0, 0, 40), (0, 0, 40), (0, 0, 30), (0, 1, 40), (1, 0, 40), (2, 2, 0), (2, 2, 0)], 2, 100)   # repeats and ties
def test_admission_reasons_match_sequential_fold(spark, raw, max_open, max_exp):
    caps = ledger.RiskCaps(max_open_positions=max_open, max_total_exposure_cents=max_exp, max_bets_per_day=3)
    cands = [(p, f"T{t}", a) for p, t, a in raw]
    df = spark.createDataFrame([("p", t, i, a, "ok") for i, t, a in cands],
                               "portfolio string, ticker string, prio bigint, ask_cents int, eligibility string")
    state = spark.createDataFrame([("p", 0, 0, 0)], "portfolio string, n_open int, exposure_cents int, n_entries int")
    adm = ledger.capped_admission(df, state, caps)
    got = [(r["prio"], r["ticker"], r["ask_cents"], r["reason"])
           for r in ledger.admission_reasons(df, state, adm, caps).collect()]
    assert sorted(got) == sorted(_fold_reasons(cands, caps))
