"""Segmented prefix scan: running aggregates in order that stay parallel inside a hot group.

A window over ``partitionBy(keys).orderBy(order)`` sorts a whole group in one task. Any associative
aggregate can be scanned in three phases instead:

1. range buckets: groups of more than ``max_rows`` rows get split points from a quantile sketch of
   their order tuples (a uniform sample of ``SAMPLES`` rows a bucket, so its size grows with the rows);
2. bucket totals: one partially aggregated row per (group, bucket);
3. carry-in: an exclusive scan over a group's buckets, joined back to the rows scanned inside theirs.

The result does not depend on where the split points fall. Groups that fit are scanned by the plain
window, and where all do, no bucket is made and nothing is joined. Rows equal in all of ``order``
stay in one bucket, in any order as in the plain window; further order columns split them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.ordered import join_keys
from gridcast.session import cut_lineage

MAX_ROWS = 1_000_000
SAMPLES = 64
SMALL = 10_000      # buckets up to which a table of them is broadcast


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


@dataclass(frozen=True)
class _Op:
    running: Callable[[Column], Column]                 # over rows or over a whole group
    bucket: Callable[[Column, Column], Column]          # of a bucket, given its order tuple
    merge: Callable[[Column], Column]                   # over a group's buckets
    join: Callable[[Column, Column], Column]            # what came before, what the bucket has


OPS = {
    "sum": _Op(F.sum, lambda c, o: F.sum(c), F.sum, _plus),
    "count": _Op(F.count, lambda c, o: F.count(c), F.sum, _plus),
    "min": _Op(F.min, lambda c, o: F.min(c), F.min, F.least),
    "max": _Op(F.max, lambda c, o: F.max(c), F.max, F.greatest),
    "last": _Op(lambda c: F.last(c, ignorenulls=True), lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
                lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


@dataclass(frozen=True)
class Scan:
    """One running aggregate: ``op`` of OPS over ``column`` (None: rows, for a count), with or
    without the row itself. ``last`` is the last non-null value."""

    op: str
    column: str | None = None
    inclusive: bool = True

    @property
    def value(self) -> Column:
        return F.lit(1) if self.column is None else F.col(self.column)


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """(keys, points) of the groups with more than ``max_rows`` rows: ascending order tuples that
    cut a group into about 2 n / max_rows ranges. Written, since a sample is not the same twice."""
    drawn = df.select(*keys, F.when(F.rand(17) < 2.0 * SAMPLES / max_rows, F.struct(*order)).alias("_row"))
    stats = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_list("_row").alias("_s"))
    hot = stats.where(F.col("_n") > max_rows).withColumn("_s", F.sort_array("_s"))
    buckets = F.ceil(F.col("_n") * 2 / max_rows).cast("int")
    points = F.transform(F.sequence(F.lit(1), buckets - 1),
                         lambda i: F.get("_s", F.floor(i * F.size("_s") / buckets).cast("int")))
    return cut_lineage(hot.select(*keys, F.array_distinct(F.array_compact(points)).alias("points")))


def bucket_of(points: Column, row: Column, most: int) -> Column:
    """Number of ascending ``points`` (at most ``most``) that are not above ``row``, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in range(max(most.bit_length(), 1))][::-1])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(points, at + step - 1) <= row, at + step).otherwise(at))


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Mapping[str, Scan],
                totals: Mapping[str, Scan] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` with a column for each of ``scans`` (running over the rows of the same ``keys`` in
    ascending ``order``, nulls first) and of ``totals`` (over the whole group; not
    ``last``). Null keys are a group; an exclusive scan of a group's first row is null (0 for a count)."""
    keys, order, totals = list(keys), list(order), dict(totals or {})
    hot = split_points(df, keys, order, max_rows)
    size = hot.agg(F.count(F.lit(1)), F.sum(F.size("points") + 1), F.max(F.size("points"))).first()

    def over(part: list[str]) -> list[Column]:
        w = Window.partitionBy(*part).orderBy(*order)
        cols = [OPS[s.op].running(s.value).over(w.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1))
                .alias(c) for c, s in scans.items()]
        return cols + [OPS[s.op].running(s.value).over(Window.partitionBy(*part)).alias(c) for c, s in totals.items()]

    if not size[0]:
        return df.select("*", *over(keys))
    small = F.broadcast if size[1] <= SMALL else (lambda x: x)
    row = F.struct(*order)
    d = join_keys(df, small(hot), keys, "left").withColumn(
        "_b", F.when(F.col("points").isNotNull(), bucket_of(F.col("points"), row, size[2]))).drop("points")
    d = d.withColumn("_b", F.coalesce("_b", F.lit(-1)))     # -1: a group that fits
    named = {**scans, **totals}
    per = d.where(F.col("_b") >= 0).groupBy(*keys, "_b").agg(
        *[OPS[s.op].bucket(s.value, row).alias(f"_in_{c}") for c, s in named.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b",
                       *[OPS[s.op].merge(F.col(f"_in_{c}")).over(before).alias(f"_in_{c}") for c, s in scans.items()],
                       *[OPS[s.op].merge(F.col(f"_in_{c}")).over(Window.partitionBy(*keys)).alias(f"_in_{c}")
                         for c, s in totals.items()])
    out = join_keys(d.select("*", *over([*keys, "_b"])), small(carry), [*keys, "_b"], "left")
    return out.select(*df.columns,
                      *[OPS[s.op].join(F.col(f"_in_{c}"), F.col(c)).alias(c) for c, s in scans.items()],
                      *[F.coalesce(F.col(f"_in_{c}"), F.col(c)).alias(c) for c in totals])
