import datetime as dt
import json
import os

from pyspark.sql import functions as F

from gridcast.operators import ledger
from gridcast.plans.cycle import run_cycle
from gridcast.sinks import writers
from gridcast.sources import landed


def test_series_pages_monthly_bad_values_and_last_page(spark, tmp_path):
    pages = [{"series_id": "s", "page": 1, "response": {"data": [{"period": "2024-01", "value": "5"},
                                                                  {"period": "2024-02", "value": "x"}]}},
             {"series_id": "s", "page": 2, "response": {"data": [{"period": "2024-02", "value": "7.5"},
                                                                  {"period": "2024-03-04", "value": ""}]}}]
    p = tmp_path / "pages.json"
    p.write_text("\n".join(json.dumps(x) for x in pages))
    got = sorted(tuple(r) for r in landed.read_series_pages(spark, str(p)).collect())
    assert got == [("s", dt.date(2024, 1, 1), 5.0), ("s", dt.date(2024, 2, 1), 7.5), ("s", dt.date(2024, 3, 4), None)]


def test_forecast_payload_first_n_days_and_alerts(spark, tmp_path):
    day = 1704110400  # 2024-01-01 12:00 UTC
    rows = [{"station": "A", "alerts": [{"event": "storm"}],
             "daily": [{"dt": day + i * 86400, "temp": {"day": 50.0 + i}, "wind_speed": 36.0, "humidity": 1.0}
                       for i in range(4)]},
            {"station": "B", "alerts": [], "daily": [{"dt": day, "temp": None, "wind_speed": 35.0}]}]
    p = tmp_path / "fc.json"
    p.write_text("\n".join(json.dumps(x) for x in rows))
    got = landed.read_forecast_payload(spark, str(p), days_ahead=2).orderBy("station_id", "date").collect()
    assert [(r["station_id"], r["date"], r["temp"], r["alert"]) for r in got] == [
        ("A", dt.date(2024, 1, 1), 50.0, 1), ("A", dt.date(2024, 1, 2), 51.0, 1), ("B", dt.date(2024, 1, 1), None, 0)]


def test_previous_forecast_version_and_as_of(spark):
    s = spark.createDataFrame([("x", dt.date(2024, 1, 1), "a", 1.0, 1), ("x", dt.date(2024, 1, 2), "a", 2.0, 2),
                               ("x", dt.date(2024, 1, 3), "a", 3.0, 1)],
                              "series_id string, run_ts date, channel string, value double, version int")
    got = landed.previous_forecast(s, F.lit("2024-01-03").cast("date")).collect()
    assert [(r["run_ts"], r["value"]) for r in got] == [(dt.date(2024, 1, 1), 1.0)]


def test_sinks_roundtrip(spark, tmp_path):
    wide = spark.createDataFrame([("x", 1.0, None, 3)], "series_id string, t double, w double, f int")
    long = writers.save_current_forecast(wide, ["series_id"], F.lit("2024-01-01").cast("date"), str(tmp_path / "fc"))
    assert sorted((r["channel"], r["value"]) for r in long.collect()) == [("f", 3.0), ("t", 1.0)]
    writers.append_model_snapshot(spark.createDataFrame([(1.0,)], "a double"), str(tmp_path / "snap"))
    writers.append_model_snapshot(spark.createDataFrame([(2.0, 5)], "a double, rows_train int"), str(tmp_path / "snap"))
    snap = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "snap"))
    assert set(snap.columns) == {"a", "rows_train"} and snap.count() == 2
    sig = spark.createDataFrame([("T", 3, 20, 80, None, 0.1, "NO_TRADE", "volume_too_low")],
                                "ticker string, volume int, open_interest int, yes_ask_cents int, spread_cents int, "
                                "edge double, decision string, reason_code string").withColumn(
        "no_ask_cents", F.lit(82))
    writers.write_signals_csv(sig, str(tmp_path / "csv"))
    txt = "".join(open(os.path.join(tmp_path / "csv", f)).read() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert "volume_too_low (3<25)" in txt and txt.startswith("ticker")


POS_COLS = ("portfolio string, id bigint, ticker string, side string, entry_price_cents int, contracts int, "
            "status string, hedge_id bigint, decision_json string, exit_price_cents int, exited_at timestamp, "
            "realized_pnl_cents int")


def test_ledger_lifecycle_smoke(spark):
    """empty -> open -> one open -> close at 100 -> no open, P&L 58 (the reference smoke run)."""
    empty_pos = spark.createDataFrame([], POS_COLS)
    trades = spark.createDataFrame([], "portfolio string, position_id bigint, ticker string, side string, "
                                       "action string, price_cents int, contracts int, created_at timestamp, kind string")
    quotes = spark.createDataFrame([], "ticker string, yes_ask_cents int, no_ask_cents int")
    status = spark.createDataFrame([], "ticker string, status string, yes_settled_price string, "
                                       "settlement_value string, result string, ts timestamp")
    tk = "SERIES-26MAY01-T3.000"
    sig = spark.createDataFrame([("p", tk, "BUY_YES", 42, 60, 1)],
                                "portfolio string, ticker string, decision string, yes_ask_cents int, "
                                "no_ask_cents int, prio bigint")
    d1 = F.lit("2026-05-01").cast("date")
    r1 = run_cycle(empty_pos, trades, quotes, status, sig, d1, F.lit("2026-05-01 12:00:00").cast("timestamp"))
    pos1 = r1.positions
    assert [(r["ticker"], r["status"], r["entry_price_cents"]) for r in ledger.open_positions(pos1).collect()] == [(tk, "open", 42)]
    status2 = spark.createDataFrame([(tk, "settled", "100", None, "yes", dt.datetime(2026, 5, 2))],
                                    "ticker string, status string, yes_settled_price string, settlement_value string, "
                                    "result string, ts timestamp")
    r2 = run_cycle(pos1, r1.trades, quotes, status2, sig.limit(0), F.lit("2026-05-02").cast("date"),
                   F.lit("2026-05-02 12:00:00").cast("timestamp"))
    closed = r2.positions.collect()
    assert len(closed) == 1 and closed[0]["status"] == "closed" and closed[0]["realized_pnl_cents"] == 58
    assert ledger.open_positions(r2.positions).count() == 0
    kinds = sorted(r["kind"] for r in r2.trades.collect())
    assert kinds == ["entry", "exit"]


def test_station_cache_upsert_touches_only_batch_years(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = spark.createDataFrame([(1, dt.date(2022, 5, 1), 1.0), (1, dt.date(2023, 5, 1), 2.0)],
                                  "station_id int, date date, temp double")
    cache.withColumn("year", F.year("date")).write.partitionBy("year").parquet(path)
    fresh = spark.createDataFrame([(1, dt.date(2023, 5, 1), 20.0), (2, dt.date(2023, 6, 1), 3.0)],
                                  "station_id int, date date, temp double")
    writers.upsert_station_cache(path, fresh)
    got = sorted((r["station_id"], r["date"], r["temp"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, dt.date(2022, 5, 1), 1.0), (1, dt.date(2023, 5, 1), 20.0), (2, dt.date(2023, 6, 1), 3.0)]
