"""Ordered-neighbour scans that stay parallel inside a hot group.

``lead`` over ``Window.partitionBy(group)`` puts a whole group in one task. Here each group is
cut into contiguous ranges of the (numeric) order key, sized from the group's row count; the
successor is taken inside a range, and the last row of a range takes the first row of the next
non-empty range from a small (group, range) table. The result equals the plain window ``lead``
ordered by (key, tiebreak...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_keys(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key meets a null key; the keys are those of ``df``."""
    right = small.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(right, same, how).drop(*[f"__{k}" for k in keys])


def bucketed_lead(df: DataFrame, group: Sequence[str], key: str, tiebreak: Sequence[str],
                  values: Sequence[str], max_rows_per_task: int = 1_000_000,
                  prefix: str = "next_") -> DataFrame:
    """Add ``next_<v>`` for ``v`` in ``values`` (and ``next_<key>``): the value of the next row
    in (key, *tiebreak) order within the group, NULL for the group's last row.

    Rows sharing one key value always share a range, so a single key value holding most of a
    group is the remaining limit (then the range is that key's rows)."""
    group = list(group)
    cols = [key, *tiebreak, *values]
    stats = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_klo"),
                                   F.max(key).alias("_khi"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / float(max_rows_per_task))).cast("int")
    frac = (F.col(key) - F.col("_klo")) / (F.col("_khi") - F.col("_klo"))
    bucket = F.when(F.col("_khi") > F.col("_klo"),
                    F.least(F.floor(frac * nb), nb - 1)).otherwise(0).cast("int")
    d = join_keys(df, stats, group).withColumn("_b", bucket).drop("_n", "_klo", "_khi")
    w = Window.partitionBy(*group, "_b").orderBy(key, *tiebreak)
    d = d.select("*", F.lead(F.lit(1)).over(w).alias("_has_next"),
                 *[F.lead(F.col(c)).over(w).alias(f"_in_{c}") for c in [key, *values]])
    order = F.struct(*[F.col(c) for c in [key, *tiebreak]])
    firsts = d.groupBy(*group, "_b").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_f"))
    firsts = firsts.select(*group, "_b", F.lead("_f").over(Window.partitionBy(*group).orderBy("_b")).alias("_nf"))
    d = join_keys(d, firsts, [*group, "_b"], "left")
    out = d.select(*df.columns, *[F.when(F.col("_has_next").isNotNull(), F.col(f"_in_{c}"))
                                  .otherwise(F.col(f"_nf.{c}")).alias(f"{prefix}{c}") for c in [key, *values]])
    return out


def bucketed_last_non_null(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
                           bucket: str, out: str = "_filled") -> DataFrame:
    """Running ``last(value, ignorenulls)`` over (group ordered by ``order``), computed as a
    two-phase scan so one group is spread over its buckets (``bucket`` must be monotone in the
    order, e.g. a date bucket): a running fill inside each (group, bucket), each bucket's last
    non-null value (partial aggregate), a carry-in scan over the small (group, bucket) table,
    and a join back on (group, bucket)."""
    group = list(group)
    ordk = F.struct(*[F.col(c) for c in order])
    w = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_in", F.last(F.col(value), ignorenulls=True).over(w))
    ends = df.groupBy(*group, bucket).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), ordk)).alias("_out"))
    wb = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*group, bucket, F.last("_out", ignorenulls=True).over(wb).alias("_carry"))
    d = join_keys(d, carry, [*group, bucket], "left")
    return d.withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_in", "_carry")
