from pyspark.sql import functions as F

from gridcast.learn.models import ensemble_blend, load_model
from gridcast.operators import ladder
from gridcast.operators import timeseries as ts


def test_years_to_refresh(spark):
    cache = spark.createDataFrame([(2019,), (2020,), (2022,), (2023,)], "year int")
    got = sorted(r["year"] for r in ts.years_to_refresh(cache, 2019, 2024).collect())
    assert got == [2021, 2023, 2024]   # missing 2021 and 2024, plus the last two years


def test_static_grid_rule(spark):
    g = [r["strike"] for r in ladder.static_grid(spark).orderBy("strike").collect()]
    assert len(g) == 131 and g[0] == 1.5 and g[-1] == 8.0 and g[1] == 1.55


def test_finite_all_and_blend(spark):
    df = spark.createDataFrame([(float("inf"), 1.0, 3.0), (float("nan"), 2.0, 5.0)], "a double, b double, m double")
    got = [tuple(r) for r in ts.finite_all(df).select("a").collect()]
    assert got == [(None,), (None,)]
    out = df.select(ensemble_blend(["b", "m"]).alias("e"), ensemble_blend(["b", "m"], "m", 0.5).alias("w")).collect()
    assert [(r["e"], r["w"]) for r in out] == [(2.0, 2.5), (3.5, 4.25)]


def test_load_model_absent_is_none(tmp_path):
    assert load_model(str(tmp_path / "nope")) is None


def test_feature_columns_and_ensure_columns(spark):
    df = spark.createDataFrame([("s", None, 1.0, 2.0)], "series_id string, date date, target double, x double")
    assert ts.feature_columns(df) == ["x"]
    out = ts.ensure_columns(df, {"wind": "double", "storm": "int:0", "x": "double"})
    r = out.collect()[0]
    assert r["wind"] is None and r["storm"] == 0 and r["x"] == 2.0


def test_run_report_doc_and_market_views(spark, tmp_path):
    import json, os
    from gridcast.sinks import writers
    from gridcast.operators.timeseries import attach_snapshot
    probs = spark.createDataFrame([("e", 3.0, 0.7), ("e", 3.25, 0.4)], "event_id string, strike double, prob double")
    sig = spark.createDataFrame([("e", "T1", "BUY_YES")], "event_id string, ticker string, decision string")
    meta = spark.createDataFrame([("e", 3.1)], "event_id string, forecast double")
    rep = writers.run_report(sig, probs, meta, ["event_id"])
    writers.write_run_report(rep, str(tmp_path / "rep"))
    f = [x for x in os.listdir(tmp_path / "rep") if x.endswith(".json")]
    doc = json.loads(open(os.path.join(tmp_path / "rep", f[0])).read().splitlines()[0])
    assert doc["threshold_probabilities"] == {"3.000": 0.7, "3.250": 0.4}
    assert doc["signals"] == [{"ticker": "T1", "decision": "BUY_YES"}]
    views = spark.createDataFrame([("T1", 0.1)], "ticker string, edge double")
    writers.write_market_views(views, str(tmp_path / "mv"), F.lit("2024-01-02").cast("date"))
    assert spark.read.parquet(str(tmp_path / "mv")).select("capture_date").first()[0].isoformat() == "2024-01-02"
    snap = spark.createDataFrame([("2024-01-02", 0.3)], "as_of string, xk_a_avg_prob double")
    rows = spark.createDataFrame([("s", "2024-01-02"), ("s", "2024-01-03")], "series_id string, as_of string")
    got = {r["as_of"]: r["xk_a_avg_prob"] for r in attach_snapshot(rows, snap, ["as_of"]).collect()}
    assert got == {"2024-01-02": 0.3, "2024-01-03": None}


def test_importance_audit_and_holdout_dump(spark, tmp_path):
    import os
    from gridcast.sinks import writers
    s = spark.createDataFrame([("a", 0.1, 3), ("b", 0.5, 5)], "feature string, mean_importance double, positive_folds int")
    writers.write_importance_audit(s, str(tmp_path / "imp"))
    txt = "".join(open(os.path.join(tmp_path / "imp", f)).read() for f in os.listdir(tmp_path / "imp") if f.endswith(".csv"))
    assert txt.splitlines()[1].startswith("b,")
    pairs = spark.createDataFrame([(0.1234567, 1.0, 3.1)], "prob double, label double, strike double")
    writers.write_holdout_dump(pairs, str(tmp_path / "ho"))
    csv = "".join(open(os.path.join(tmp_path / "ho" / "csv", f)).read() for f in os.listdir(tmp_path / "ho" / "csv") if f.endswith(".csv"))
    assert "0.123457,1,3.100" in csv


def test_snapshot_wide_pivot(spark):
    from gridcast.operators.quotes import snapshot_wide
    snap = spark.createDataFrame([("a", 2, 5, 0.4, 0.5), ("b", 0, 0, None, None)],
                                 "label string, n_open bigint, vol_sum bigint, avg_prob double, max_prob double")
    r = snapshot_wide(snap, ["a", "b"]).collect()[0].asDict()
    assert r["xk_a_n_open"] == 2 and r["xk_a_max_prob"] == 0.5 and r["xk_b_avg_prob"] is None


def test_save_and_load_model_roundtrip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from gridcast.learn.models import save_model
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    save_model(m, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    assert loaded is not None and loaded.transform(df).first()["v"].toArray().tolist() == [1.0, 2.0]
