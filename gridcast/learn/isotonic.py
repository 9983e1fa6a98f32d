"""Isotonic calibration per group (M6): pool adjacent violators as a fold over sorted scores.

Calibration rows are first reduced to (group, score) -> (weight, positives) by partial aggregation.
The scores of a group are then folded in order on a stack of blocks: each step pushes the next score
or, while the two topmost blocks are out of order, unites them. Uniting blocks commutes, so groups of
more than ``max_scores`` distinct scores are folded in score ranges first and their blocks once more;
what is gathered per group in the end is its calibration map. Scores are mapped by interpolation
between the blocks, clipped at both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators import ladder
from gridcast.operators.ordered import join_keys
from gridcast.operators.scan import bucket_of, split_points
from gridcast.session import cut_lineage

MAX_SCORES = 2048


def _pool(blocks: Column) -> Column:
    """Pooled blocks of an array of (lo, hi, w, p) in ascending order; p/w is a block's mean. Every
    step unites or pushes, so 2 n steps end with everything pushed and in order."""
    start = F.struct(F.slice(blocks, 1, 0).alias("stack"), F.lit(0).alias("next"))

    def step(acc: Column, _: Column) -> Column:
        stack, at = acc["stack"], acc["next"]
        a, b = F.get(stack, F.size(stack) - 2), F.get(stack, F.size(stack) - 1)
        one = F.struct(a["lo"].alias("lo"), b["hi"].alias("hi"), (a["w"] + b["w"]).alias("w"), (a["p"] + b["p"]).alias("p"))
        united = F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(one))
        pushed = F.concat(stack, F.array(F.get(blocks, at)))
        more = at < F.size(blocks)
        return (F.when((F.size(stack) > 1) & (a["p"] * b["w"] >= b["p"] * a["w"]),
                       F.struct(united.alias("stack"), at.alias("next")))
                .when(more, F.struct(pushed.alias("stack"), (at + 1).alias("next"))).otherwise(acc))

    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(blocks)), start, step, lambda acc: acc["stack"])


def _fold(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    held = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "w", "p"))).alias("_b"))
    return held.select(*by, F.inline(_pool(F.col("_b"))))


def isotonic_blocks(cal: DataFrame, group: Sequence[str], score: str = "prob", label: str = "label",
                    weight: str | None = None, max_scores: int = MAX_SCORES) -> DataFrame:
    """(group..., lo, hi, w, p): the blocks of the least-squares non-decreasing map of each group,
    equal scores as one. Rows with a null score or label, or without weight, do not count."""
    group = list(group)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = cal.where(F.col(score).isNotNull() & F.col(label).isNotNull() & (w > 0))
    one = rows.groupBy(*group, F.col(score).cast("double").alias("lo")).agg(
        F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("p"))
    one = cut_lineage(one.select(*group, "lo", F.col("lo").alias("hi"), "w", "p"))
    hot = split_points(one, group, ["lo"], max_scores)
    most = hot.agg(F.max(F.size("points"))).first()[0]
    if most:
        cut = join_keys(one, hot, group, "left").withColumn(
            "_r", F.coalesce(bucket_of(F.col("points"), F.struct("lo"), most), F.lit(0)))
        one = _fold(cut.drop("points"), [*group, "_r"]).drop("_r")
    return _fold(one, group)


def calibrate(cal: DataFrame, apply_to: DataFrame, group: Sequence[str], score: str = "prob", label: str = "label",
              out: str = "calibrated_prob", min_rows: int = 20, max_scores: int = MAX_SCORES) -> DataFrame:
    """``apply_to`` with ``out``: its score through the map fitted on ``cal`` for its group. Groups
    with fewer than ``min_rows`` calibration rows or with one class keep the raw score."""
    group = list(group)
    known = cal.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    fit = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_a"), F.max(label).alias("_z"))
    fit = cut_lineage(fit.where((F.col("_n") >= min_rows) & (F.col("_a") < F.col("_z"))).select(*group, F.lit(True).alias("_fit")))
    blocks = isotonic_blocks(join_keys(known, fit, group).drop("_fit"), group, score, label, max_scores=max_scores)
    points = blocks.select(*group, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_x"), (F.col("p") / F.col("w")).alias("_y"))
    wanted = join_keys(apply_to.drop(out), fit, group, "left")
    keep = [c for c in apply_to.columns if c != out]
    raw = wanted.select(*group, F.struct(*keep).alias("_row"), F.coalesce("_fit", F.lit(False)).alias("_fit"),
                        F.col(score).cast("double").alias("_x"))
    mapped = ladder.interpolate(points, raw, group, strike="_x", prob="_y", lo=0.0, hi=1.0)
    # interpolate() keeps the wanted rows' columns but its strike is read from the row
    return mapped.select(*[F.col(f"_row.{c}").alias(c) for c in keep],
                         F.when(F.col("_fit") & F.col(f"_row.{score}").isNotNull(), F.col("prob"))
                         .otherwise(F.col(f"_row.{score}")).alias(out))
