"""Edges of settlement, gates and ingest."""

from pyspark.sql import functions as F

from gridcast.functions.scalar import num
from gridcast.operators import ledger
from gridcast.operators.ordered import bucketed_last_non_null, bucketed_lead


def test_settlement_edges(spark):
    pos = spark.createDataFrame([("p", i, f"T{i}", "YES", 40, 1) for i in range(4)],
                                "portfolio string, id int, ticker string, side string, entry_price_cents int, contracts int") \
        .withColumn("status", F.lit("open"))
    status = spark.createDataFrame([("T0", "settled", None, "0", None), ("T1", "settled", "0", "0", "yes"),
                                    ("T2", None, "100", None, None), ("T3", "active", "100", None, None)],
                                   "ticker string, status string, yes_settled_price string, settlement_value string, result string")
    got = {r.ticker: r.exit_price_cents for r in ledger.settlements(pos, status).collect()}
    assert got == {"T0": 0, "T1": 0, "T2": 100}


def test_non_finite_text_is_null(spark):
    rows = spark.createDataFrame([("NaN",), ("Infinity",), ("-inf",), ("1.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(num("t")).collect()] == [None, None, None, 1.5, None, None]


def test_tied_candidates_are_all_admitted(spark):
    cand = spark.createDataFrame([("p", "T2", 1, 30), ("p", "T1", 1, 20), ("p", "T3", 2, 10), ("p", "T4", 3, None)],
                                 "portfolio string, ticker string, prio int, ask_cents int").withColumn("eligibility", F.lit("ok"))
    state = spark.createDataFrame([("p", 0, 0, 0)], "portfolio string, n_open int, exposure_cents int, n_entries int")
    caps = ledger.RiskCaps(max_open_positions=4, max_total_exposure_cents=1000)
    adm = ledger.capped_admission(cand, state, caps)
    assert [r.ticker for r in adm.orderBy("round").collect()] == ["T1", "T2", "T3"]
    why = {r.ticker: r.reason for r in ledger.admission_reasons(cand, state, adm, caps).collect()}
    assert why == {"T1": "ok", "T2": "ok", "T3": "ok", "T4": "invalid_ask"}


def test_ordered_scans_keep_the_null_group(spark):
    rows = spark.createDataFrame([(None, 1, 10), (None, 2, 20), ("g", 1, 5), ("g", 3, 6)], "g string, k int, v int")
    got = {(r.g, r.k): r.next_v for r in bucketed_lead(rows, ["g"], "k", [], ["v"], max_rows_per_task=1).collect()}
    assert got == {(None, 1): 20, (None, 2): None, ("g", 1): 6, ("g", 3): None}
    gaps = spark.createDataFrame([(None, 1, 0, 7), (None, 2, 1, None)], "g string, k int, b int, v int")
    filled = bucketed_last_non_null(gaps, ["g"], ["k"], "v", "b").orderBy("k").collect()
    assert [r._filled for r in filled] == [7, 7]
