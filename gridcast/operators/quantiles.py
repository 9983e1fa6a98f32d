"""Exact grouped quantiles by distributed radix selection.

``percentile`` holds the counts of all distinct values of a group in one buffer. Here a double is
read as a 64-bit integer of the same order, and the wanted ranks are found digit by digit: a
histogram of the next 16 bits per group (partial aggregation, at most 65,536 rows a group), a running
sum over it, and only the bucket of a wanted rank is looked at again. Buckets of at most ``max_rows``
distinct values are ended by counting their values; after the fourth digit a bucket is one value, so
there are at most four histograms whatever the data. No task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.ordered import join_keys
from gridcast.session import cut_lineage

DIGIT = 16
MAX_ROWS = 1_000_000


def ordered_bits(value: Column) -> Column:
    """64-bit integer that orders as the double does: NaN above all, -0.0 as 0.0."""
    some = F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), some).cast("long")
    return F.when(value.isNull(), None).when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _prefix(level: int) -> Column:
    return F.shiftright("_k", 64 - DIGIT * level)


def _found(counts: DataFrame, wanted: DataFrame, by: list[str], digit: str) -> DataFrame:
    """``wanted`` (by..., _r: rank among the rows of ``by``) with the ``digit`` that holds it, the
    rank inside and the rows of the digit."""
    w = Window.partitionBy(*by).orderBy(digit)
    c = counts.withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = join_keys(c, wanted, by).where((F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("_c")))
    return j.withColumn("_r", F.col("_r") - (F.col("_to") - F.col("_c"))).drop("_to")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                    max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per group with ``q0``, ``q1``, ... for ``probs``: linear interpolation between the two
    nearest ranks, as ``percentile`` gives. Null values do not count; a group without values has
    null quantiles; a null group is a group."""
    group = list(group)
    rows = cut_lineage(df.select(*group, ordered_bits(F.col(value)).alias("_k"), F.col(value).cast("double").alias("_v")))
    some = rows.where(F.col("_v").isNotNull())
    hist = cut_lineage(some.groupBy(*group, _prefix(1).alias("_d")).agg(F.count(F.lit(1)).alias("_c")))
    n = hist.groupBy(*group).agg(F.sum("_c").alias("_n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("_q"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_at"))
                      for i, p in enumerate(probs)])
    wanted = n.select(*group, F.explode(ranks).alias("_w")).select(
        *group, "_w._q", "_w._at", F.explode(F.array_distinct(F.array(F.floor("_w._at"), F.ceil("_w._at")))).alias("_rank"))
    wanted = wanted.withColumn("_r", F.col("_rank"))
    held = cut_lineage(_found(hist, wanted, group, "_d").withColumnRenamed("_d", "_p"))
    level = 1
    while level < 64 // DIGIT and (held.agg(F.max("_c")).first()[0] or 0) > max_rows:
        level += 1
        at = held.select(*group, "_p").distinct()
        part = join_keys(some.withColumn("_p", _prefix(level - 1)), at, [*group, "_p"])
        hist = part.groupBy(*group, "_p", _prefix(level).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        held = _found(hist, held.drop("_c"), [*group, "_p"], "_d")
        held = cut_lineage(held.drop("_p").withColumnRenamed("_d", "_p"))
    at = held.select(*group, "_p").distinct()
    last = join_keys(some.withColumn("_p", _prefix(level)), at, [*group, "_p"])
    counts = last.groupBy(*group, "_p", "_k").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"))
    got = _found(counts, held.drop("_c"), [*group, "_p"], "_k")
    share = F.col("_at") - F.floor("_at")
    parts = got.groupBy(*group, "_q").agg(
        F.min_by(F.col("_v"), F.col("_rank")).alias("_lo"), F.max_by(F.col("_v"), F.col("_rank")).alias("_hi"),
        F.max(share).alias("_s"))
    between = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        (1.0 - F.col("_s")) * F.col("_lo") + F.col("_s") * F.col("_hi"))
    wide = parts.groupBy(*group).agg(*[F.max(F.when(F.col("_q") == i, between)).alias(f"q{i}") for i in range(len(probs))])
    return join_keys(rows.select(*group).distinct(), wide, group, "left")
