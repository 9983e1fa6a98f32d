"""Blocked co-moments against pandas and NumPy."""

import numpy as np
import pandas as pd

from gridcast.operators import comoments as cm
from gridcast.operators import metrics as mx


def test_183_features_in_one_pass(spark):
    rng = np.random.default_rng(1)
    p, n = 183, 400
    base = rng.normal(size=(n, 12)) @ rng.normal(size=(12, p)) + rng.normal(size=(n, p))
    x = base * 10.0 ** rng.integers(-3, 6, p) + 10.0 ** rng.integers(0, 9, p)
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 7], x[:, 8], x[5:, 9] = 4.1, np.nan, np.nan
    names = [f"f{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in names))
    got = mx.pairwise_corr(df.repartition(6), names)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") <= 2
    got = got.toPandas()
    assert len(got) == p * (p - 1) // 2
    want = (pdf - pdf.min()).corr(min_periods=2)     # about a value, as exact as the data
    expect = np.array([want.loc[a, b] for a, b in zip(got.f1, got.f2, strict=True)])
    few = got[(got.f1 == "f9") | (got.f2 == "f9")].index
    keep = ~got.index.isin(few)
    np.testing.assert_allclose(got["corr"].to_numpy(float)[keep], expect[keep], rtol=1e-6, atol=1e-9)
    assert got[(got.f1 == "f7") | (got.f2 == "f7") | (got.f1 == "f8") | (got.f2 == "f8")]["corr"].isna().all()
    place = {f: i for i, f in enumerate(names)}
    assert all(place[a] < place[b] for a, b in zip(got.f1, got.f2, strict=True))


def test_wide_and_narrow_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(g) if g < 3 else None, *[None if rng.random() < 0.2 else float(v) for v in rng.normal(size=4)])
            for g in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    for group in ([], ["g"]):
        narrow = {(r.f1, r.f2, *r[:len(group)]): r["corr"] for r in mx.pairwise_corr(df, list("abcd"), group).collect()}
        monkeypatch.setattr(mx, "WIDE", 1)
        monkeypatch.setattr(cm, "HELD", 2)
        wide = {(r.f1, r.f2, *r[:len(group)]): r["corr"] for r in mx.pairwise_corr(df, list("abcd"), group).collect()}
        monkeypatch.undo()
        assert set(narrow) == set(wide) and all(abs(narrow[k] - wide[k]) < 1e-9 for k in narrow)


def test_moments_are_sums_over_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (None, 5.0), (float("nan"), 7.0), (5.0, float("inf"))],
                               "a double, b double")
    r = [r for r in cm.comoments(df, ["a", "b"]).collect() if (r.i, r.j) == (0, 1)][0]
    assert (r.n, r.xi, r.xj) == (2, 1.0, 5.0)
    assert (r.si, r.sj, r.sii, r.sjj, r.sij) == (2.0, 30.0, 4.0, 650.0, 50.0)
    assert cm.comoments(df.limit(0), ["a", "b"], ["a"]).count() == 0
