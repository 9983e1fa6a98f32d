"""End-to-end training and evaluation (M9), composed from the distributed parts:
chronological split (O3) -> walk-forward importance and selection (M7, M8) -> elastic net
(M3) -> quantile boosters (M4) -> robust residual spread (A13) -> training grid (L5) ->
pooled strike classifier (L8, M5) with isotonic calibration (M6) -> metrics (A14-A16).

Returns fitted models plus small metric tables; no training data is collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.learn import isotonic
from gridcast.learn import models as ml
from gridcast.operators import ladder
from gridcast.operators import metrics as mx


@dataclass
class TrainedModel:
    features: list[str]
    elastic_net: object
    quantiles: dict = field(default_factory=dict)
    classifier: object = None
    residual_std: DataFrame | None = None
    regression: DataFrame | None = None
    per_strike: DataFrame | None = None
    macro: DataFrame | None = None


def train_model(frame: DataFrame, candidates: Sequence[str], keys: Sequence[str] = ("series_id",),
                label: str = "target", n_test: int = 120, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95),
                n_trees: int = 20, grid_step: float = 0.10, calibration_rows: int = 60,
                select: bool = True) -> TrainedModel:
    keys = list(keys)
    d = mx.chrono_split(frame, keys, n_test)
    tr, te = d.where(F.col("role") == "train"), d.where(F.col("role") == "test")
    feats = list(candidates)
    if select:
        imp = ml.permutation_importance(tr, feats, keys, label=label, repeats=2)
        sel = ml.select_features(imp, mx.pairwise_corr(tr, feats))
        feats = [r["feature"] for r in sel.orderBy("rank").select("feature").collect()] or feats
    en = ml.fit_elastic_net(tr, feats, label=label, keys=keys)   # one path per key
    qm = {a: ml.fit_quantile_boost(tr, feats, a, label=label, n_trees=n_trees) for a in quantiles}
    med = ml.predict_quantile_boost(qm[0.5], te, out="pred") if 0.5 in qm else en.transform(te).withColumnRenamed(
        "prediction", "pred")
    resid = med.select(*keys, (F.col(label) - F.col("pred")).alias("r"))
    spread = mx.robust_spread(resid, keys, "r")
    reg = mx.regression_metrics(med, keys, label, "pred")
    grid = ladder.training_grid(tr, keys, label, step=grid_step)
    x = ml.exploded_strikes(d, grid, keys, label=label)
    tail = mx.chrono_split(tr.select(*keys, "date").distinct(), keys, calibration_rows).withColumnRenamed(
        "role", "cal_role")
    xt = x.where(F.col("role") == "train").join(tail, [*keys, "date"])
    clf = ml.fit_strike_classifier(xt.where(F.col("cal_role") == "train"), feats)
    cal = ml.prob_of_one(clf.transform(xt.where(F.col("cal_role") == "test")))
    scored = isotonic.calibrate(cal.select(*keys, "strike", "prob", "label"),
                                ml.prob_of_one(clf.transform(x.where(F.col("role") == "test"))), [*keys, "strike"])
    pairs = scored.select(F.col("strike").alias("threshold"), F.col("calibrated_prob").alias("predicted_prob"),
                          F.col("label").cast("int").alias("actual_label"))
    per = mx.binary_metrics(pairs, ["threshold"])
    return TrainedModel(feats, en, qm, clf, spread, reg, per, mx.macro_metrics(per))
