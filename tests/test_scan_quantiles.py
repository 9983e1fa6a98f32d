"""Segmented prefix scans and radix-selected quantiles against plain windows and NumPy, on one hot
group cut into many buckets, with ties, nulls and a null group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcast.operators import ladder
from gridcast.operators import metrics as mx
from gridcast.operators.quantiles import exact_quantiles, ordered_bits
from gridcast.operators.scan import Scan, bucket_of, prefix_scan, split_points

SCANS = {"s": Scan("sum", "v"), "s_ex": Scan("sum", "v", inclusive=False), "c": Scan("count"),
         "c_ex": Scan("count", "v", inclusive=False), "lo": Scan("min", "v"), "hi": Scan("max", "v", inclusive=False),
         "last": Scan("last", "v")}
TOTALS = {"n": Scan("count"), "total": Scan("sum", "v"), "top": Scan("max", "v")}


@pytest.fixture(scope="module")
def rows(spark):
    """3000 rows of one group over 12 dates (one of them null, one with a third of the rows), small
    groups and a null group beside it."""
    r = random.Random(4)
    days = [None, *range(11)]
    big = [("hot", 5 if r.random() < 0.33 else r.choice(days), i, None if r.random() < 0.2 else r.randrange(-50, 50))
           for i in range(3000)]
    small = [(g, r.randrange(4), 5000 + i, r.randrange(9)) for i, g in enumerate(["a", "a", "b", None, None] * 6)]
    return spark.createDataFrame(big + small, "g string, day int, id int, v long").repartition(7).cache()


def plain(df):
    w = Window.partitionBy("g").orderBy("day", "id")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("g")
    return df.select("*", F.sum("v").over(up).alias("s"), F.sum("v").over(before).alias("s_ex"), F.count("*").over(up).alias("c"),
                     F.count("v").over(before).alias("c_ex"), F.min("v").over(up).alias("lo"), F.max("v").over(before).alias("hi"),
                     F.last("v", ignorenulls=True).over(up).alias("last"), F.count("*").over(every).alias("n"),
                     F.sum("v").over(every).alias("total"), F.max("v").over(every).alias("top"))


def test_prefix_scan_equals_the_plain_window(rows):
    points = split_points(rows, ["g"], ["day", "id"], max_rows=100).collect()
    assert [p.g for p in points] == ["hot"] and len(points[0].points) >= 20
    got = prefix_scan(rows, ["g"], ["day", "id"], SCANS, TOTALS, max_rows=100)
    want = plain(rows).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_prefix_scan_without_hot_groups_has_no_join(rows):
    got = prefix_scan(rows, ["g"], ["day", "id"], SCANS, TOTALS)
    want = plain(rows).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_order_values_stay_together(rows):
    """Ties in the whole order: what the last of them sees is the plain window's."""
    got = prefix_scan(rows, ["g"], ["day"], {"s": Scan("sum", "v"), "c": Scan("count")}, max_rows=100)
    peers = got.groupBy("g", "day").agg(F.max("c").alias("c"), F.max_by("s", "c").alias("s"), F.countDistinct("c").alias("d"),
                                        F.count("*").alias("k"))
    w = Window.partitionBy("g").orderBy("day")
    want = rows.select("g", "day", F.count("*").over(w).alias("c"), F.sum("v").over(w).alias("s")).distinct()
    got = peers.collect()
    assert all(r.d == r.k for r in got)
    assert sorted([(r.g, r.day, r.c, r.s) for r in got], key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_bucket_of_is_the_number_of_points_not_above(spark):
    got = spark.range(-2, 12).select("id", bucket_of(F.array(*[F.lit(p).cast("long") for p in (0, 3, 3, 7, 9)]), F.col("id"), 5).alias("b"))
    assert [(r.id, r.b) for r in got.collect()] == [(i, sum(p <= i for p in (0, 3, 3, 7, 9))) for i in range(-2, 12)]


def test_splits_metrics_and_ladder_on_a_hot_group(spark):
    r = random.Random(8)
    days = spark.createDataFrame([("hot", i) for i in r.sample(range(9000), 1500)] + [("x", i) for i in range(7)], "k string, date int")
    for f, args in ((mx.chrono_split, (["k"], 120)), (mx.walk_forward_folds, (["k"], 5))):
        a, b = (sorted(map(tuple, f(days, *args, max_rows=m).collect())) for m in (40, 10**6))
        assert a == b and len(a) > 1500
    pred = spark.createDataFrame([("t", r.randrange(500) / 500, r.randrange(2)) for _ in range(2000)],
                                 "threshold string, predicted_prob double, actual_label int")
    a, b = (mx.binary_metrics(pred, ["threshold"], max_rows=m).collect() for m in (20, 10**6))
    assert a == b
    rungs = spark.createDataFrame([("e", k, r.random()) for k in range(1200)], "row_id string, strike_mills int, prob double")
    a, b = (sorted(map(tuple, ladder.monotone(rungs, ["row_id"], max_rows=m).collect())) for m in (30, 10**6))
    assert a == b and all(y[3] <= x[3] for x, y in zip(a, a[1:]))


def test_ordered_bits_order_as_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -2.0, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf"), float("nan")]
    got = [r.k for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("k")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    zero = spark.createDataFrame([(-0.0,), (0.0,)], "v double").select(ordered_bits(F.col("v")).alias("k")).distinct()
    assert zero.count() == 1


@pytest.mark.parametrize("max_rows", [1, 30, 10**6])
def test_quantiles_equal_numpy(spark, max_rows):
    rng = np.random.default_rng(2)
    data = {"near": 3.0 + rng.normal(0, 1e-9, 400), "wide": rng.normal(0, 1, 300) * 10.0 ** rng.integers(-200, 200, 300),
            "ties": rng.integers(0, 4, 500) / 3.0, "one": np.array([7.5]), "same": np.full(200, -0.1), None: rng.normal(0, 5, 101)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("near", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: r[1:] for r in exact_quantiles(df, ["g"], "v", probs, max_rows).collect()}
    assert got.pop("empty") == (None,) * 5 and set(got) == set(data)
    for g, vs in data.items():
        for p, q in zip(probs, got[g], strict=True):
            assert math.isclose(q, np.percentile(vs, 100 * p), rel_tol=1e-12), (g, p)
    plain = {r.g: r[1:] for r in df.groupBy("g").agg(*[F.percentile("v", p) for p in probs]).collect()}
    for g in data:
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[g], plain[g], strict=True))


def test_robust_spread_on_a_hot_group(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_t(2, 900)
    df = spark.createDataFrame([("s", float(x)) for x in v], "g string, r double")
    for max_rows in (10, 10**6):
        r = mx.robust_spread(df, ["g"], "r", max_rows=max_rows).first()
        assert math.isclose(r.median_resid, np.median(v)) and math.isclose(r.residual_std, 1.4826 * np.median(abs(v - np.median(v))))
    assert mx.robust_spread(df.limit(0), ["g"], "r").count() == 0
