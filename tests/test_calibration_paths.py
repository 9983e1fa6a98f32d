"""Isotonic blocks, elastic-net paths, strike counts, the keyed bijection and versioned tables against
plain algorithms on small data."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.learn import elastic_path as ep
from gridcast.learn import isotonic
from gridcast.learn import models as ml
from gridcast.operators import ladder
from gridcast.operators import timeseries as ts
from gridcast.sinks import writers


def min_max(points):
    """Isotonic means of (score, weight, positives) by the max-min formula."""
    x, w, p = map(np.array, zip(*points, strict=True))
    mean = lambda a, b: p[a:b + 1].sum() / w[a:b + 1].sum()
    n = len(x)
    return x, np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


@pytest.mark.parametrize("max_scores", [4, 2048])
def test_blocks_equal_the_min_max_formula(spark, max_scores):
    r = random.Random(3)
    data = {"noisy": [(r.randrange(60) / 60, r.random() < 0.5) for _ in range(300)],
            "rising": [(i / 40, r.random() < i / 40) for i in range(40)],
            "falling": [(i / 30, i < 15) for i in range(30)], None: [(0.5, True), (0.5, False), (0.7, True)]}
    rows = [(g, s, int(y), r.choice([1.0, 2.0])) for g, v in data.items() for s, y in v]
    rows += [("noisy", None, 1, 1.0), ("noisy", 0.2, None, 1.0), ("noisy", 0.2, 1, 0.0)]
    df = spark.createDataFrame(rows, "g string, prob double, label int, w double").repartition(3)
    got = {}
    for b in isotonic.isotonic_blocks(df, ["g"], weight="w", max_scores=max_scores).collect():
        got.setdefault(b.g, []).append(b)
    assert set(got) == set(data)
    for g in data:
        sums = {}
        for h, s, y, w in rows:
            if h == g and s is not None and y is not None and w > 0:
                a = sums.setdefault(s, [0.0, 0.0])
                a[0] += w
                a[1] += w * y
        x, y = min_max([(s, *sums[s]) for s in sorted(sums)])
        blocks = sorted(got[g])
        assert [b.p / b.w for b in blocks] == sorted(b.p / b.w for b in blocks)
        for s, v in zip(x, y, strict=True):
            own = [b for b in blocks if b.lo <= s <= b.hi]
            assert len(own) == 1 and own[0].p / own[0].w == pytest.approx(v)


def test_calibration_per_group(spark):
    r = random.Random(5)
    cal = [("a", 3.0, s := r.random(), int(r.random() < s * s)) for _ in range(80)]
    cal += [("a", 4.0, 0.3, 1)] * 30 + [("b", 3.0, 0.1 * i, i % 2) for i in range(9)]     # one class; too few rows
    new = [("a", 3.0, i / 20, f"r{i}") for i in range(-2, 24)] + [("a", 4.0, 0.2, "x"), ("b", 3.0, 0.4, "y"), ("c", 1.0, 0.6, "z"),
                                                                  ("a", 3.0, None, "null")]
    cal_df = spark.createDataFrame(cal, "series_id string, strike double, prob double, label int")
    new_df = spark.createDataFrame(new, "series_id string, strike double, prob double, row string")
    got = {x.row: x.calibrated_prob for x in isotonic.calibrate(cal_df, new_df, ["series_id", "strike"]).collect()}
    assert (got.pop("x"), got.pop("y"), got.pop("z"), got.pop("null")) == (0.2, 0.4, 0.6, None)
    x, y = min_max(sorted((s, 1, y) for g, k, s, y in cal if (g, k) == ("a", 3.0)))
    for _, _, s, row in new[:26]:
        assert got[row] == pytest.approx(np.interp(s, x, y)), row
    assert isotonic.calibrate(cal_df.limit(0), new_df, ["series_id", "strike"]).where("calibrated_prob = prob").count() == 29


def plain_descent(x, y, ratios, n_alphas, eps, folds):
    """The same choice from the rows themselves: residual descent, each fold left out in turn."""
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)

    def path(x, y, alphas, r):
        xc, yc = x - x.mean(0), y - y.mean()
        b, out, n = np.zeros(x.shape[1]), [], len(y)
        for a in alphas:
            res = yc - xc @ b
            for _ in range(4000):
                worst = 0
                for j in range(len(b)):
                    sq = xc[:, j] @ xc[:, j]
                    if sq < 1e-12:
                        continue
                    rho = xc[:, j] @ res + sq * b[j]
                    new = np.sign(rho) * max(abs(rho) - n * a * r, 0) / (sq + n * a * (1 - r))
                    res -= xc[:, j] * (new - b[j])
                    worst, b[j] = max(worst, abs(new - b[j])), new
                if worst < 1e-11:
                    break
            out.append((b.copy(), y.mean() - x.mean(0) @ b))
        return out

    blocks = np.array_split(np.arange(len(y)), folds)
    best = None
    for r in ratios:
        top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (len(y) * r)
        alphas = np.geomspace(top, top * eps, n_alphas)
        mse = np.zeros(n_alphas)
        for f in blocks:
            train = np.setdiff1d(np.arange(len(y)), f)
            for k, (b, b0) in enumerate(path(x[train], y[train], alphas, r)):
                mse[k] += ((y[f] - b0 - x[f] @ b) ** 2).mean() / folds
        k = int(mse.argmin())
        if best is None or mse[k] < best[0]:
            best = (mse[k], r, alphas[k], *path(x, y, alphas[:k + 1], r)[-1])
    mse, r, a, b, b0 = best
    return r, a, mse, x @ b + b0


def _panel(n, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 5, 0.1, 2, 1, 1] + offset
    x[:, 3] = x[:, 0] + 0.3 * x[:, 3]
    y = 2 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(0, 1.5, n)
    x[rng.random((n, 6)) < 0.1] = np.nan
    x[:, 5] = 7.0
    return x, y


def test_path_equals_plain_descent(spark):
    names = [f"f{i}" for i in range(6)]
    data = {"a": _panel(83, 1), "b": _panel(60, 2, offset=1e4)}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in x], float(t))
            for s, (xs, ys) in data.items() for i, (x, t) in enumerate(zip(xs, ys, strict=True))]
    rows += [("a", dt.date(2021, 1, 1), *[1.0] * 6, None), ("one", dt.date(2020, 1, 1), *[1.0] * 6, 5.0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"series_id string, date date, {', '.join(c + ' double' for c in names)}, target double")
    net = ep.fit_paths(df, names, n_alphas=25)
    models = {m.series_id: m for m in net.models.collect()}
    out = {(r.series_id, r.date): r.prediction for r in net.transform(df).collect()}
    for s, (x, y) in data.items():
        r, a, mse, pred = plain_descent(x, y, ep.RATIOS, 25, ep.EPS, 5)
        assert models[s].l1_ratio == r and models[s].alpha == pytest.approx(a, rel=1e-6)
        assert models[s].cv_mse == pytest.approx(mse, rel=1e-5)
        mine = [out[s, dt.date(2020, 1, 1) + dt.timedelta(days=i)] for i in range(len(y))]
        np.testing.assert_allclose(mine, pred, rtol=1e-5, atol=1e-5)
    assert out["one", dt.date(2020, 1, 1)] == 5.0
    other = net.transform(spark.createDataFrame([("new", *[1.0] * 6)], f"series_id string, {', '.join(c + ' double' for c in names)}"))
    assert other.first().prediction is None


def test_path_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7), 3.0 * (i % 7)) for i in range(40)],
                               "series_id string, date date, x double, target double")
    net = ep.fit_paths(df, ["x"])
    net.save(str(tmp_path / "net"))
    again = ep.load_paths(spark.read.parquet(str(tmp_path / "net")), ["x"])
    assert again.transform(df).collect() == net.transform(df).collect()


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 13), ("b", 3)) for i in range(n)], "k string, date int")
    got = {}
    for r in ep.blocks_in_order(df, ["k"], 5, "date").collect():
        got.setdefault(r.k, {})[r.date] = r.fold
    assert [got["a"][i] for i in range(13)] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2
    assert [got["b"][i] for i in range(3)] == [0, 1, 2]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_keyed_positions_are_permutations(spark, n):
    keys = spark.range(3).select(F.xxhash64("id").alias("key"))
    rows = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    got = rows.withColumn("to", ml.permuted_position(F.col("pos"), F.lit(n).cast("long"), F.col("key"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, {})[r.pos] = r.to
    assert all(sorted(m.values()) == list(range(n)) for m in by.values())
    if n == 1000:
        a, b, _ = by.values()
        assert sum(a[i] == b[i] for i in a) < 20 and sum(a[i] == i for i in a) < 20
        assert abs(np.corrcoef(list(a), list(a.values()))[0, 1]) < 0.1


def test_importance_has_no_window_and_whole_repeats(spark):
    rnd = random.Random(2)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), rnd.uniform(0, 10), rnd.uniform(0, 10)) for s in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "series_id string, date date, x double, noise double").withColumn("target", 3 * F.col("x"))
    plans, cut = [], ml.cut_lineage
    ml.cut_lineage = lambda d, *a: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d, *a)
    try:
        imp = ml.permutation_importance(df, ["x", "noise"], max_iter=5).collect()
    finally:
        ml.cut_lineage = cut
    assert len(imp) == 10 and all(r.importance > 1 for r in imp if r.feature == "x")
    assert len(plans) == 6 and not any("Window" in p for p in plans[1:])


def test_class_counts_without_the_row_strike_table(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([(g, r.choice([None, *range(-3, 14)]) if g != "c" else 2) for g in "aab" * 60 + "c"], "g string, y int")
    rows = rows.withColumn("y", F.col("y").cast("double"))
    grid = spark.createDataFrame([(g, float(k)) for g in "abd" for k in range(0, 11, 2)], "g string, strike double")
    got = ladder.class_counts(rows, grid, ["g"], "y")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    labels = ladder.threshold_labels(rows, grid, ["g"], "y").groupBy("g", "strike").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_pos"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, labels.collect()))
    assert plan.count("Generate") == 1 and "strike" in plan            # the grid's own array, not the rows
    assert ladder.class_counts(rows.limit(0), grid, ["g"], "y").count() == 0


def test_versions_without_a_commit_are_not_read(spark, tmp_path):
    base = str(tmp_path / "ledger")
    one, two = spark.range(3), spark.range(5).withColumn("more", F.lit("x"))
    assert writers.latest_version(spark, base) is None and writers.read_positions_version(spark, base) is None
    writers.write_positions_version(one, base, 1, commit=False)
    assert writers.read_positions_version(spark, base) is None
    writers.write_positions_version(one, base, 1)
    writers.write_positions_version(two, base, 2, commit=False)
    assert writers.read_positions_version(spark, base).count() == 3
    writers.write_positions_version(two, base, 2)
    assert writers.read_positions_version(spark, base).columns == ["id", "more"]
    assert writers.read_positions_version(spark, base, 1).count() == 3 and writers.read_positions_version(spark, base, 9) is None
    with pytest.raises(ValueError):
        writers.write_positions_version(one, base, 2)


def test_snapshots_merge_their_columns(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert writers.read_model_snapshots(spark, path) is None
    writers.append_model_snapshot(spark.createDataFrame([(1, 2.0)], "run int, a double"), path)
    writers.append_model_snapshot(spark.createDataFrame([(2, 3.0, 5)], "run int, a double, rows_train int"), path)
    assert sorted(map(tuple, writers.read_model_snapshots(spark, path).collect())) == [(1, 2.0, None), (2, 3.0, 5)]


def test_refresh_reads_only_its_years(spark, tmp_path):
    days = [(s, dt.date(y, 1, d)) for s in (1, 2) for y in range(2015, 2025) for d in (1, 2)]
    obs = spark.createDataFrame(days, "station_id int, date date").withColumn("year", F.year("date"))
    landed, cache = str(tmp_path / "landed"), str(tmp_path / "cache")
    obs.withColumn("temp", F.lit(2.0)).write.partitionBy("year").parquet(landed)
    obs.where("year <> 2018").withColumn("temp", F.lit(1.0)).write.partitionBy("year").parquet(cache)
    years = ts.years_to_refresh(spark.read.parquet(cache).select("year"), 2015, 2024)
    plan = spark.read.parquet(landed).join(F.broadcast(years), "year", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    before = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "cache").glob("year=*")}
    writers.refresh_station_cache(cache, spark.read.parquet(landed), years)
    after = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "cache").glob("year=*")}
    assert {y for y in after if after[y] != before.get(y)} == {"year=2018", "year=2023", "year=2024"}
    got = {(r.year, r.temp) for r in spark.read.parquet(cache).select("year", "temp").distinct().collect()}
    assert got == {(y, 2.0 if y in (2018, 2023, 2024) else 1.0) for y in range(2015, 2025)}


def test_descent_work_does_not_depend_on_correlation():
    import time

    r = np.random.default_rng(11)
    begun = time.time()
    for t in range(60):
        x = r.normal(size=(200, 1)) + 1e-3 * r.normal(size=(200, 11))          # nearly the same column
        x = (x - x.mean(0)) / x.std(0)
        y = x @ r.normal(size=11) + r.normal(size=200)
        q, c = x.T @ x, x.T @ (y - y.mean())
        top = np.abs(c).max()
        b = np.zeros(11)
        for a in np.geomspace(top, top * 1e-3, 20):
            l1, l2 = a * 0.5, a * 0.5
            b = ep.descend(q, c, l1, l2, b)
            left = c - q @ b - l2 * b
            slack = 1e-8 * top
            assert (np.abs(left) <= l1 + slack).all()                          # the conditions of the minimum
            assert np.allclose(left[b != 0], l1 * np.sign(b[b != 0]), atol=slack)
    assert time.time() - begun < 10                                            # minutes by coordinate descent


def test_descent_of_equal_and_constant_columns():
    x = np.random.default_rng(3).normal(size=(50, 3))
    x = np.column_stack([x, x[:, 0], np.zeros(50)])
    q, c = x.T @ x, x.T @ (x[:, 0] + 2 * x[:, 1])
    for l2 in (0.0, 1e-3, 5.0):
        b = ep.descend(q, c, 3.0, l2, np.zeros(5))
        left = c - q @ b - l2 * b
        assert (np.abs(left) <= 3.0 + 1e-5).all() and b[4] == 0
    assert not ep.descend(np.zeros((2, 2)), np.zeros(2), 0.0, 0.0, np.zeros(2)).any()
