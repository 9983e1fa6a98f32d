import datetime as dt

from pyspark.sql import functions as F

from gridcast.operators import timeseries as ts

D = dt.date


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:2]).collect()]


def test_gap_free_spine_no_fill_and_fill_with_tail(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 4), None),
                                ("a", D(2024, 1, 5), 5.0), ("b", D(2024, 1, 2), 2.0)],
                               "series_id string, date date, v double")
    sp = ts.gap_free_spine(df, ["series_id"], ["v"])
    assert rows(sp, "series_id", "date", "v") == [
        ("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 2), None), ("a", D(2024, 1, 3), None),
        ("a", D(2024, 1, 4), None), ("a", D(2024, 1, 5), 5.0), ("b", D(2024, 1, 2), 2.0)]
    ff = ts.gap_free_spine(df, ["series_id"], ["v"], tail_days=2, fill=True)
    got = rows(ff, "series_id", "date", "v")
    # NULL observation carries the previous value; tail extends 2 days past the last obs
    assert got[:7] == [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 3), 1.0),
                       ("a", D(2024, 1, 4), 1.0), ("a", D(2024, 1, 5), 5.0), ("a", D(2024, 1, 6), 5.0),
                       ("a", D(2024, 1, 7), 5.0)]
    assert got[7:] == [("b", D(2024, 1, 2), 2.0), ("b", D(2024, 1, 3), 2.0), ("b", D(2024, 1, 4), 2.0)]


def test_asof_available_at_and_tolerance(spark):
    spine = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 5, 9, 30)], "series_id string, date date")
    obs = spark.createDataFrame([("a", D(2024, 1, 1), 10.0, D(2024, 1, 5)), ("a", D(2024, 1, 8), 20.0, D(2024, 1, 9))],
                                "series_id string, date date, value double, avail date")
    out = ts.asof_backward(spine, obs, ["series_id"], ["value"], available_at="avail", tolerance_days=20)
    got = {r["date"]: (r["value"], r["source_date"]) for r in out.collect()}
    assert got[D(2024, 1, 1)] == (None, None)            # not yet available
    assert got[D(2024, 1, 5)] == (10.0, D(2024, 1, 1))    # available on its release day
    assert got[D(2024, 1, 9)] == (20.0, D(2024, 1, 8))
    assert got[D(2024, 1, 30)] == (None, None)            # 22 days old > tolerance 20


def test_upsert_fresh_wins_cache_kept(spark):
    cache = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 2), 2.0), (2, D(2024, 1, 1), 3.0)],
                                  "station_id int, date date, temp double")
    fresh = spark.createDataFrame([(1, D(2024, 1, 2), 20.0), (1, D(2024, 1, 3), 30.0)],
                                  "station_id int, date date, temp double")
    got = sorted(tuple(r) for r in ts.upsert(cache, fresh, ["station_id", "date"]).collect())
    assert got == [(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 2), 20.0), (1, D(2024, 1, 3), 30.0),
                   (2, D(2024, 1, 1), 3.0)]


def test_streak_matches_reference_rule(spark):
    vals = [1.0, 30.0, 31.0, None, 40.0, 41.0, 42.0, 2.0, 50.0]
    df = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                               "series_id string, date date, x double")
    out = ts.streak_columns(df, [("x", 25.0, "s")], ["series_id"]).orderBy("date")
    # streak of the shifted series: counts prior rows above 25, NULL breaks it
    assert [r["s"] for r in out.collect()] == [0.0, 0.0, 1.0, 2.0, 0.0, 1.0, 2.0, 3.0, 0.0]


def test_rolling_min_periods_counts_null_slots(spark):
    vals = [None, 1.0, None, None, 2.0, None, None, 9.0, 4.0]
    df = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                               "series_id string, date date, x double")
    out = df.select("date", ts.rolling(F.col("x"), 7, 3, "mean", ["series_id"]).alias("r")).orderBy("date")
    r = [x["r"] for x in out.collect()]
    assert r[7] is None               # prior 7 rows hold only 1.0 and 2.0 (2 < 3)
    assert r[8] == (1.0 + 2.0 + 9.0) / 3


def test_degree_days_keep_null(spark):
    df = spark.createDataFrame([(None,), (60.0,), (70.0,)], "t double")
    got = [tuple(r) for r in df.select(ts.hdd(F.col("t")), ts.cdd(F.col("t"))).collect()]
    assert got == [(None, None), (5.0, 0.0), (0.0, 5.0)]


def test_feature_at_date_ignores_future_rows(spark):
    """Leakage: the feature row of date d must not change when rows on or after d change."""
    base = [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(100 + i), 50.0) for i in range(60)]
    changed = [(s, d, (v * 3 if d >= D(2024, 2, 10) else v), t) for s, d, v, t in base]
    cut = D(2024, 2, 10)

    def feats(data):
        df = spark.createDataFrame(data, "series_id string, date date, target double, temp double")
        f = ts.target_features(df, ["series_id"]).where(F.col("date") == cut)
        return [c for c in f.drop("target").collect()[0]]

    assert feats(base) == feats(changed)


def test_forecast_revision_needs_immediately_previous_run(spark):
    snap = spark.createDataFrame([
        ("s", D(2024, 1, 1), "a", 1.0, 1), ("s", D(2024, 1, 1), "b", 5.0, 1),
        ("s", D(2024, 1, 2), "a", 2.0, 1),
        ("s", D(2024, 1, 3), "a", 4.0, 1), ("s", D(2024, 1, 3), "b", 9.0, 1),
        ("s", D(2024, 1, 3), "c", 7.0, 2)],
        "series_id string, run_ts date, channel string, value double, version int")
    out = {(r["run_ts"], r["channel"]): r["revision_1d"] for r in ts.forecast_revisions(snap, ["series_id"]).collect()}
    assert out[(D(2024, 1, 2), "a")] == 1.0
    assert out[(D(2024, 1, 3), "a")] == 2.0
    assert out[(D(2024, 1, 3), "b")] is None   # channel absent from the previous run
    assert (D(2024, 1, 3), "c") not in out     # wrong version ignored


def test_asof_bucketed_equals_single_scan(spark):
    import random
    rnd = random.Random(11)
    spine = spark.createDataFrame([(k, D(2024, 1, 1) + dt.timedelta(days=i)) for k in ("a", "b") for i in range(120)],
                                  "series_id string, date date")
    obs = spark.createDataFrame([(k, D(2024, 1, 1) + dt.timedelta(days=rnd.randint(-5, 125)), float(j))
                                 for k in ("a", "b") for j in range(25)], "series_id string, date date, value double")
    obs = obs.dropDuplicates(["series_id", "date"])
    a = sorted(tuple(r) for r in ts.asof_backward(spine, obs, ["series_id"], ["value"]).collect())
    b = sorted(tuple(r) for r in ts.asof_backward(spine, obs, ["series_id"], ["value"], bucket_days=9).collect())
    assert a == b and len(a) == 240


def test_trading_days_only_lags(spark):
    rows = [("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 6), None), ("a", D(2024, 1, 7), None), ("a", D(2024, 1, 8), 2.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, target double")
    spine = {r["date"]: r["target_lag_1"] for r in ts.target_features(df, ["series_id"]).collect()}
    trade = {r["date"]: r["target_lag_1"] for r in ts.target_features(df, ["series_id"], trading_days_only=True).collect()}
    assert spine[D(2024, 1, 8)] is None and trade[D(2024, 1, 8)] == 1.0


def test_today_row_carry_static(spark):
    from gridcast.plans.daily import today_feature_rows
    hist = spark.createDataFrame([("a", D(2024, 1, d), float(d), 100.0 + d) for d in range(1, 11)],
                                 "series_id string, date date, target double, storage double")
    today = spark.createDataFrame([("a", D(2024, 1, 11))], "series_id string, date date")
    plain = today_feature_rows(hist, today, ["series_id"]).first()
    carried = today_feature_rows(hist, today, ["series_id"], carry_static=["storage"]).first()
    assert plain["storage"] is None and carried["storage"] == 110.0 and carried["target_lag_1"] == 10.0
