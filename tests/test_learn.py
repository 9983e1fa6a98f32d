"""Model bounds on a synthetic, learnable fixture (SURVEY section 5 (4)): quantile coverage and
pinball loss below the constant forecast; the calibrated probability stays in [0, 1]."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridcast.learn import models as ml


def _frame(spark, n=400):
    rnd = random.Random(1)
    rows = []
    for s in ("a", "b"):
        for i in range(n):
            x = rnd.uniform(0, 10)
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), x, 3.0 * x + rnd.gauss(0, 1.0)))
    return spark.createDataFrame(rows, "series_id string, date date, x double, target double")


def _pinball(df, col, a):
    e = F.col("target") - F.col(col)
    return df.select(F.avg(F.when(e >= 0, a * e).otherwise((a - 1) * e)).alias("l")).first()["l"]


def test_quantile_boost_coverage_and_loss(spark):
    d = _frame(spark)
    m95 = ml.fit_quantile_boost(d, ["x"], 0.95, n_trees=15, learning_rate=0.3)
    m50 = ml.fit_quantile_boost(d, ["x"], 0.5, n_trees=15, learning_rate=0.3)
    p = ml.predict_quantile_boost(m95, d, out="q95")
    p = ml.predict_quantile_boost(m50, p, out="q50")
    cov = p.select(F.avg((F.col("target") <= F.col("q95")).cast("double"))).first()[0]
    assert 0.85 <= cov <= 1.0
    med = d.agg(F.percentile("target", 0.5)).first()[0]
    const = _pinball(p.withColumn("c", F.lit(med)), "c", 0.5)
    assert _pinball(p, "q50", 0.5) < 0.5 * const


def test_elastic_net_beats_mean(spark):
    d = _frame(spark)
    m = ml.fit_elastic_net(d, ["x"])
    mae = m.transform(d).select(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    mean = d.agg(F.avg("target")).first()[0]
    base = d.select(F.avg(F.abs(F.col("target") - F.lit(mean)))).first()[0]
    assert mae < 0.3 * base


def test_permutation_importance_ranks_signal_over_noise(spark):
    rnd = random.Random(1)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), rnd.uniform(0, 10), rnd.uniform(0, 10))
            for i in range(300)]
    df = spark.createDataFrame(rows, "series_id string, date date, x double, noise double").withColumn(
        "target", 3 * F.col("x"))
    imp = ml.permutation_importance(df, ["x", "noise"], repeats=2)
    s = {r["feature"]: r["m"] for r in imp.groupBy("feature").agg(F.avg("importance").alias("m")).collect()}
    assert s["x"] > 1.0 and abs(s["noise"]) < 0.5
    summ = {r["feature"]: r["positive_folds"] for r in
            __import__("gridcast.operators.metrics", fromlist=["x"]).importance_summary(imp).collect()}
    assert summ["x"] == 5


def test_daily_scoring_composition(spark):
    from gridcast.learn.models import exploded_strikes, fit_elastic_net, fit_strike_classifier
    from gridcast.operators import ladder
    from gridcast.plans.daily import score_day, today_feature_rows
    rnd = random.Random(5)
    hist = spark.createDataFrame([(s, dt.date(2023, 1, 1) + dt.timedelta(days=i), 3.0 + 0.5 * (i % 7) / 7 + rnd.gauss(0, 0.05))
                                  for s in ("a", "b") for i in range(150)], "series_id string, date date, target double")
    feats = ["target_lag_1", "target_lag_7", "target_rolling_7", "day_of_week"]
    from gridcast.operators import timeseries as ts
    fr = ts.target_features(hist, ["series_id"]).withColumn("day_of_week", F.weekday("date").cast("double")) \
        .withColumn("month", F.month("date").cast("double"))
    point = fit_elastic_net(fr, feats)
    grid = ladder.training_grid(fr, ["series_id"], "target", step=0.1)
    clf = fit_strike_classifier(exploded_strikes(fr, grid, ["series_id"]), feats, max_iter=5)
    today = spark.createDataFrame([("a", dt.date(2023, 5, 31)), ("b", dt.date(2023, 5, 31))], "series_id string, date date")
    rows = today_feature_rows(hist, today, ["series_id"])
    assert rows.count() == 2 and rows.where(F.col("target_lag_1").isNull()).count() == 0
    resid = spark.createDataFrame([("a", 0.1), ("b", 0.1)], "series_id string, residual_std double")
    mk = spark.createDataFrame([("a", "A-3.2", 3.2, 3200, 40, 62, 100, 100), ("b", "B-9", 9.0, 9000, 40, 62, 100, 100)],
                               "series_id string, ticker string, threshold_value double, strike_mills bigint, "
                               "yes_ask_cents int, no_ask_cents int, volume bigint, open_interest bigint")
    out = score_day(hist, today, mk, point, clf, grid, resid)
    gp = out.grid_probs.collect()
    assert len(gp) == 2 * 21 and all(0.01 <= r["prob"] <= 0.99 for r in gp)
    sig = {r["ticker"]: r["decision"] for r in out.signals.collect()}
    assert set(sig) == {"A-3.2", "B-9"} and all(d in ("BUY_YES", "BUY_NO", "NO_TRADE") for d in sig.values())


def test_hist_boost_learns_and_repeats():
    import numpy as np

    from gridcast.learn import hist_boost
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    x[::7, 1] = np.nan
    x[:, 3] = np.nan
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    p = hist_boost.fit_predict(x[:600], y[:600], x[600:], 1)
    assert ((p >= 0.5) == (y[600:] == 1)).mean() > 0.95
    assert (p == hist_boost.fit_predict(x[:600], y[:600], x[600:], 2)).all()
    short = hist_boost.fit_predict(x[:600], y[:600], x[600:], 1, iterations=10)
    assert np.abs(short - 0.5).max() < np.abs(p - 0.5).max()
    big, z = np.repeat(x[:600], 20, 0), np.repeat(y[:600], 20)          # early stopping
    assert ((hist_boost.fit_predict(big, z, x[600:], 1) >= 0.5) == (y[600:] == 1)).mean() > 0.95


def test_per_strike_ensemble_scores_the_whole_grid(spark, monkeypatch):
    from gridcast.learn import hist_boost
    from gridcast.plans import q_learn
    asked = []
    whole = q_learn.ml.score_per_strike
    monkeypatch.setattr(q_learn.ml, "score_per_strike", lambda *a, **b: asked.append(b) or whole(*a, **{**b, "iterations": 2}))
    sf = "/root/testdata/sf0.001"
    got = q_learn.per_strike_ensemble(spark, sf).toPandas()
    x = q_learn._strike_tables(spark, sf).select("series_id", "strike", "date", "role", "label").toPandas()
    train, test = x[x.role == "train"], x[x.role == "test"]
    both = train.groupby(["series_id", "strike"])["label"].nunique()
    want = test.set_index(["series_id", "strike"]).index.isin(both[both == 2].index)
    assert len(got) == want.sum() and len(got[["series_id", "strike"]].drop_duplicates()) == (both == 2).sum()
    assert got["prob"].between(0, 1).all() and asked == [{}] and hist_boost.ITERATIONS == 300


def test_pooled_strike_queries_fit_the_references_iterations(spark, monkeypatch):
    from gridcast.learn import hist_boost
    from gridcast.plans import q_learn
    asked = []
    fit = q_learn.ml.fit_strike_classifier
    monkeypatch.setattr(q_learn.ml, "fit_strike_classifier",
                        lambda *a, **b: asked.append((b["max_iter"], b["step"])) or fit(*a, **{**b, "max_iter": 1}))
    for query in (q_learn.strike_classifiers, q_learn.calibrated_probs):
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [(hist_boost.ITERATIONS, hist_boost.RATE)] * 2
