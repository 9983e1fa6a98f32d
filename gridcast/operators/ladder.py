"""Strike-ladder operators.

Probabilities live in a long table ``(group..., strike, prob)``; a map is built only at a sink.
Strikes are joined on integer mills so float equality never decides a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip, gaussian_tail
from gridcast.operators.ordered import join_keys
from gridcast.operators.quantiles import exact_quantiles
from gridcast.operators.scan import Scan, bucket_of, prefix_scan
from gridcast.session import cut_lineage


def monotone(probs: DataFrame, group: Sequence[str], strike: str = "strike_mills",
             prob: str = "prob", out: str = "fixed_prob", max_rows: int = 1_000_000) -> DataFrame:
    """Running minimum over increasing strikes: P(x >= k) made non-increasing (L1, W18), as a
    segmented prefix scan: a ladder of more than ``max_rows`` strikes is scanned in ranges."""
    return prefix_scan(probs, group, [strike], {out: Scan("min", prob)}, max_rows=max_rows)


def interpolate(trained: DataFrame, wanted: DataFrame, group: Sequence[str],
                strike: str = "strike", prob: str = "fixed_prob", empty_prob: float = 0.5,
                lo: float = 0.01, hi: float = 0.99, max_rows_per_task: int = 1_000_000,
                gaussian_fallback: tuple[str, str] | None = None) -> DataFrame:
    """P(x >= k) at any wanted strike from a trained (monotone) ladder.

    Trained and wanted rows are unioned and scanned once per group ordered by strike (trained
    first on ties): the previous trained point comes from ``last(ignorenulls)`` over the rows
    so far, the next from the same scan in reverse. Exact match -> that
    probability; between -> linear; outside -> nearest end; clipped to [lo, hi]; a group
    without a trained ladder -> ``empty_prob``, or with ``gaussian_fallback=(forecast, sigma)``
    (columns of the wanted rows) the normal tail P(x >= k) (D6). No range join and no pairs
    are formed.
    Wanted rows keep all their columns.

    Hot groups are salted: a group with n wanted rows is split into ceil(n / max_rows_per_task)
    salts by a hash of the wanted row, and the (small, strike-grid sized) trained ladder of the
    group is replicated into every salt, so each scan partition holds the whole ladder and a
    bounded share of the wanted rows. Results are exact, whatever the split.
    """
    t = trained.select(*group, F.col(strike).cast("double").alias("_k"), F.lit(0).alias("_side"),
                       F.col(strike).cast("double").alias("_tk"), F.col(prob).alias("_tp"),
                       F.lit(None).cast("struct<x:int>").alias("_row"))
    wcols = [c for c in wanted.columns if c not in group]
    wnt = wanted.select(*group, F.col(strike).cast("double").alias("_k"), F.lit(1).alias("_side"),
                        F.lit(None).cast("double").alias("_tk"), F.lit(None).cast("double").alias("_tp"),
                        F.struct(*[F.col(c) for c in wcols]).alias("_row"))
    t = t.withColumn("_row", F.lit(None).cast(wnt.schema["_row"].dataType))
    salts = wanted.groupBy(*group).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / float(max_rows_per_task))).cast("int").alias("_ns"))
    wnt = join_keys(wnt, salts, list(group)).withColumn(
        "_salt", F.pmod(F.xxhash64(F.col("_row"), F.col("_k")), F.col("_ns")).cast("int")).drop("_ns")
    t = join_keys(t, salts, list(group), "left").select(
        "*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)) - 1)).alias("_salt")).drop("_ns")
    u = t.unionByName(wnt)
    w = Window.partitionBy(*group, "_salt").orderBy(F.col("_k"), F.col("_side"))
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the rows ahead are those before in the reverse order: a frame that only grows, where one that
    # shrinks from the current row to the end is computed anew for every row
    ahead = Window.partitionBy(*group, "_salt").orderBy(F.col("_k").desc(), F.col("_side").desc())
    ahead = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.select("*",
                 F.last("_tk", ignorenulls=True).over(back).alias("_lok"),
                 F.last("_tp", ignorenulls=True).over(back).alias("_lop"),
                 F.last("_tk", ignorenulls=True).over(ahead).alias("_hik"),
                 F.last("_tp", ignorenulls=True).over(ahead).alias("_hip"))
    u = u.where(F.col("_side") == 1)
    wgt = (F.col("_k") - F.col("_lok")) / (F.col("_hik") - F.col("_lok"))
    empty = (F.lit(empty_prob) if gaussian_fallback is None else gaussian_tail(
        F.col("_k"), F.col(f"_row.{gaussian_fallback[0]}"), F.col(f"_row.{gaussian_fallback[1]}")))
    p = (F.when(F.col("_lop").isNull() & F.col("_hip").isNull(), empty)
         .when(F.col("_lop").isNull(), clip(F.col("_hip"), lo, hi))
         .when(F.col("_hip").isNull(), clip(F.col("_lop"), lo, hi))
         .when(F.col("_hik") <= F.col("_lok"), clip(F.col("_lop"), lo, hi))
         .otherwise(clip((F.lit(1.0) - wgt) * F.col("_lop") + wgt * F.col("_hip"), lo, hi)))
    return u.select(*group, *[F.col(f"_row.{c}").alias(c) for c in wcols], p.alias("prob"))


def gaussian_prob(strike: Column, forecast: Column, sigma: Column) -> Column:
    """Fallback P(x >= k) from a normal residual."""
    return gaussian_tail(strike, forecast, sigma)


def dynamic_grid(centers: DataFrame, group: Sequence[str], forecast: str = "forecast",
                 sigma: str = "sigma", step: float = 0.05, span_sigma: float = 2.5,
                 n_strikes: int = 21) -> DataFrame:
    """Grid centred on the forecast (L4, F11): centre snapped half-even to the step,
    half-width max(round_half_even(span*sigma/step), (n-1)/2), strikes rounded to 4 places."""
    center = F.bround(F.col(forecast) / step, 0) * step
    half = F.greatest(F.bround(F.lit(span_sigma) * F.col(sigma) / step, 0).cast("int"),
                      F.lit((n_strikes - 1) // 2))
    g = centers.select(*group, center.alias("_c"), half.alias("_h"))
    g = g.select(*group, "_c", F.explode(F.sequence(-F.col("_h"), F.col("_h"))).alias("i"))
    return g.select(*group, F.col("i").cast("int").alias("i"),
                    F.bround(F.col("_c") + F.col("i") * step, 4).alias("strike"))


def training_grid(series: DataFrame, group: Sequence[str], value: str, step: float = 0.10,
                  q_lo: float = 0.05, q_hi: float = 0.95, max_rows: int = 1_000_000) -> DataFrame:
    """Training grid from the 5-95 % quantiles snapped outward to the step (L5, A12). The
    quantiles are exact with linear interpolation, selected by radix digits."""
    q = exact_quantiles(series, group, value, [q_lo, q_hi], max_rows)
    q = q.select(*group, (F.floor(F.col("q0") / step) * step).alias("_lo"),
                 (F.ceil(F.col("q1") / step) * step).alias("_hi"))
    n = F.bround((F.col("_hi") - F.col("_lo")) / step, 0).cast("int")
    g = q.select(*group, "_lo", F.explode(F.sequence(F.lit(0), n)).alias("_i"))
    return g.select(*group, F.round(F.col("_lo") + F.col("_i") * step, 3).alias("strike"))


def static_grid(spark, lo: float = 1.50, step: float = 0.05, n: int = 131) -> DataFrame:
    """Static strike grid 1.50 ... 8.00 by 0.05 (L6), generated by rule."""
    return spark.range(n).select(F.round(F.lit(lo) + F.col("id") * step, 3).alias("strike"))


def threshold_labels(rows: DataFrame, grid: DataFrame, group: Sequence[str], value: str,
                     strike: str = "strike") -> DataFrame:
    """Label y >= k for every row and every grid strike of its group (L8). The grid per group
    is bounded by (q95 - q05) / step, so the output is rows x grid by definition; the join is
    an equi-join on the group, never a cross join."""
    return rows.join(grid, list(group)).withColumn(
        "label", (F.col(value) >= F.col(strike)).cast("int"))


def class_counts(rows: DataFrame, grid: DataFrame, group: Sequence[str], value: str,
                 strike: str = "strike") -> DataFrame:
    """(group..., strike, n, n_pos): rows and rows with value >= strike of every grid strike (A17),
    without the row x strike table: each value falls between two strikes, values are counted by that
    place (partial aggregation), and a strike's positives are the counts at or above it. A group's
    strikes are an array (the grid is bounded by its step); strikes of a group without rows have
    no counts, null values count as rows without a label of 1."""
    group = list(group)
    strikes = cut_lineage(grid.groupBy(*group).agg(F.sort_array(F.collect_set(F.col(strike).cast("double"))).alias("_ks")))
    most = strikes.agg(F.max(F.size("_ks"))).first()[0] or 0
    known = join_keys(rows.select(*group, F.col(value).cast("double").alias("_v")), strikes, group)
    place = F.when(F.col("_v").isNull(), 0).otherwise(bucket_of(F.col("_ks"), F.col("_v"), most))
    found = known.groupBy(*group, "_ks", place.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    held = found.groupBy(*group, "_ks").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_c"))).alias("_m"))
    total = lambda lo: F.aggregate(F.sequence(lo, F.size("_ks")), F.lit(0).cast("long"),
                                   lambda acc, k: acc + F.coalesce(F.try_element_at("_m", k), F.lit(0)))
    each = F.transform("_ks", lambda k, i: F.struct(k.alias("strike"), total(F.lit(0)).alias("n"), total(i + 1).alias("n_pos")))
    return held.select(*group, F.inline(each)).withColumnRenamed("strike", strike)
