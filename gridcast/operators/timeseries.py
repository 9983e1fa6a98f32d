"""Time-series operators: spine, fill, as-of, upsert, lags, rolling windows, streaks.

Every operator takes ``keys`` (the series columns) so one plan serves any number of series.
Windows are always ``partitionBy(*keys)``: per-key work is bounded by the number of days in a
series (a century is 36.5k rows), while the raw feeds that produce the daily rows are reduced
with partial (map-side) aggregation before any shuffle, so a hot series never lands whole in
one task before it has been reduced to one row per day.

Row-frame semantics follow the reference: ``shift(n)`` / ``rolling(n)`` count rows, and a null
row still takes a slot, so the rolling features run on a gap-free daily spine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.scalar import safe_ln

Keys = Sequence[str]


def wspec(keys: Keys, date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


# --------------------------------------------------------------------------- T1 / T2 / J2

def gap_free_spine(df: DataFrame, keys: Keys, value_cols: Sequence[str], date: str = "date",
                   tail_days: int = 0, fill: bool = False) -> DataFrame:
    """Daily spine min(date)..max(date)+tail per key (T1), optionally forward filled.

    ``df`` holds at most one row per (keys, date). Instead of joining a calendar to the data,
    each observation is expanded to the days up to the next observation (``lead`` + ``explode``
    of a date ``sequence``): one exchange on the keys, no join, no cross product.
    With ``fill`` the carried value is the last non-null value so far (reindex + ffill);
    without it the gap days are NULL (reindex only).
    """
    w = wspec(keys, date)
    nxt = F.lead(F.col(date)).over(w)
    end = F.coalesce(F.date_sub(nxt, 1), F.date_add(F.col(date), tail_days))
    cols = [F.col(k) for k in keys]
    carried = []
    for c in value_cols:
        if fill:
            carried.append(F.last(F.col(c), ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)).alias(c))
        else:
            carried.append(F.col(c))
    staged = df.select(*cols, F.col(date).alias("_obs_date"), end.alias("_end"), *carried)
    out = staged.select(*cols, F.explode(F.sequence(F.col("_obs_date"), F.col("_end"))).alias(date),
                        "_obs_date", *value_cols)
    if not fill:
        out = out.select(*cols, date, *[F.when(F.col(date) == F.col("_obs_date"), F.col(c)).alias(c)
                                        for c in value_cols])
    else:
        out = out.select(*cols, date, *value_cols)
    return out


def asof_backward(spine: DataFrame, obs: DataFrame, keys: Keys, value_cols: Sequence[str],
                  date: str = "date", obs_date: str = "date", available_at: str | None = None,
                  tolerance_days: int | None = None, bucket_days: int | None = None) -> DataFrame:
    """Backward as-of join (J2): for each spine row, the latest observation usable on that day.

    An observation is usable from ``available_at`` (if given) else from its own date. The two
    inputs are unioned and scanned once with ``last(..., ignorenulls)`` over the key window —
    one shuffle, no range join and no pair blow-up. ``tolerance_days`` nulls matches older than
    the tolerance. ``bucket_days`` switches to a two-phase scan over (keys, date bucket)
    (``ordered.bucketed_last_non_null``) for raw, high-frequency feeds where one key may hold
    a large share of the rows.
    """
    avail = F.col(available_at) if available_at else F.col(obs_date)
    packed = F.struct(F.col(obs_date).alias("_src_date"), *[F.col(c) for c in value_cols])
    o = obs.select(*keys, avail.cast("date").alias(date), F.lit(0).alias("_side"),
                   packed.alias("_pk"))
    s = spine.select(*keys, F.col(date), F.lit(1).alias("_side"),
                     F.lit(None).cast(o.schema["_pk"].dataType).alias("_pk"))
    # ties: observations before spine rows on the same day; among observations released the
    # same day the one with the latest source date wins
    u = o.unionByName(s).withColumn("_sd", F.col("_pk._src_date"))
    if bucket_days:
        from gridcast.operators.ordered import bucketed_last_non_null
        u = u.withColumn("_bk", F.floor(F.unix_date(F.col(date)) / bucket_days))
        u = bucketed_last_non_null(u, keys, [date, "_side", "_sd"], "_pk", "_bk", out="_m")
    else:
        w = (Window.partitionBy(*keys).orderBy(F.col(date), F.col("_side"), F.col("_sd"))
             .rowsBetween(Window.unboundedPreceding, 0))
        u = u.withColumn("_m", F.last("_pk", ignorenulls=True).over(w))
    u = u.where(F.col("_side") == 1)
    ok = F.lit(True)
    if tolerance_days is not None:
        ok = F.datediff(F.col(date), F.col("_m._src_date")) <= tolerance_days
    out = u.select(*keys, date, *[F.when(ok, F.col(f"_m.{c}")).alias(c) for c in value_cols],
                   F.when(ok, F.col("_m._src_date")).alias("source_date"))
    extra = [c for c in spine.columns if c not in set(keys) | {date}]
    if extra:
        out = spine.join(out, [*keys, date], "left")
    return out


# --------------------------------------------------------------------------- T4 / U2

def latest_per_key(df: DataFrame, keys: Keys, order_cols: Sequence[str]) -> DataFrame:
    """Keep one row per key: the one with the greatest ``order_cols`` (T4, A9); of equals the one of
    greatest content, column by column, so reruns agree.

    ``max_by`` is a partial aggregate: each task reduces its rows before the shuffle, so a key
    holding a third of the data costs one row per task, not a sort of the whole group.
    """
    payload = [c for c in df.columns if c not in keys]
    content = [c for c in payload if c not in order_cols and "map<" not in df.schema[c].dataType.simpleString()
               and "variant" not in df.schema[c].dataType.simpleString()]
    order = F.struct(*[F.col(c) for c in [*order_cols, *content]])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), order).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload])


def upsert(cache: DataFrame, fresh: DataFrame, keys: Keys) -> DataFrame:
    """cache UNION fresh, fresh wins per key (U1 + U2). Rows only in the cache are kept."""
    c = cache.withColumn("_prio", F.lit(0))
    f = fresh.withColumn("_prio", F.lit(1))
    u = c.unionByName(f, allowMissingColumns=True)
    return latest_per_key(u, keys, ["_prio"]).drop("_prio")


# --------------------------------------------------------------------------- T3

def stale_tail_patch(panel: DataFrame, estimates: DataFrame, keys: Keys, value: str,
                     anchor_date: Column, lo: float, hi: float, date: str = "date") -> DataFrame:
    """Patch a stale series tail.

    ``estimates`` has one live estimate per key (column ``estimate``). When it lies in [lo, hi]
    the days strictly between the last non-null observation and the anchor get the last value,
    and the anchor day gets the estimate. Keys whose estimate is out of bounds are unchanged.
    """
    last = (panel.where(F.col(value).isNotNull())
            .groupBy(*keys).agg(F.max_by(F.struct(F.col(date).alias("d"), F.col(value).alias("v")),
                                         F.col(date)).alias("_l")))
    est = (estimates.where(F.col("estimate").between(lo, hi))
           .join(last, list(keys), "inner")
           .withColumn("_anchor", anchor_date))
    gap = est.where(F.col("_l.d") < F.col("_anchor")).select(*keys, F.explode(F.sequence(F.date_add(F.col("_l.d"), 1),
                                                  F.col("_anchor"))).alias(date),
                     "_l", "_anchor", "estimate")
    gap = gap.where(F.col(date) <= F.col("_anchor")).select(
        *keys, date,
        F.when(F.col(date) == F.col("_anchor"), F.col("estimate"))
        .otherwise(F.col("_l.v")).alias("_patch"))
    anchor_only = est.where(F.col("_l.d") >= F.col("_anchor")).select(
        *keys, F.col("_anchor").alias(date), F.col("estimate").alias("_patch"))
    patches = gap.unionByName(anchor_only)
    merged = panel.join(patches, [*keys, date], "full_outer")
    return merged.withColumn(value, F.coalesce(F.col("_patch"), F.col(value))).drop("_patch")


# --------------------------------------------------------------------------- T5

def persistence_forecast(panel: DataFrame, keys: Keys, value_cols: Sequence[str], horizon: int,
                         date: str = "date") -> DataFrame:
    """Carry the last row forward ``horizon`` days (T5, A9); horizon 1 is the next-day row."""
    last = panel.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(date).alias("_d"), *[F.col(c) for c in value_cols]),
                 F.col(date)).alias("_l"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"),
                       "_l").select(*keys, F.date_add(F.col("_l._d"), F.col("horizon")).alias(date),
                                    "horizon", *[F.col(f"_l.{c}").alias(c) for c in value_cols])


# --------------------------------------------------------------------------- T6 / T7

def hdd(t: Column, base: float = 65.0) -> Column:
    """Heating degree days, NULL kept (bare greatest(NULL, 0) would give 0)."""
    return F.when(t.isNotNull(), F.greatest(F.lit(base) - t, F.lit(0.0)))


def cdd(t: Column, base: float = 65.0) -> Column:
    return F.when(t.isNotNull(), F.greatest(t - F.lit(base), F.lit(0.0)))


def guarded(agg: Column, x: Column, w, min_periods: int) -> Column:
    """pandas rolling(min_periods=k): the aggregate only when >= k non-null rows in the frame."""
    return F.when(F.count(x).over(w) >= min_periods, agg.over(w))


def day_range_window(keys: Keys, days_back: int, days_fwd: int = 0, date: str = "date"):
    """Calendar-day RANGE frame: identical to a row frame on a gap-free daily spine, without
    materialising the spine."""
    return (Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date)))
            .rangeBetween(-days_back, days_fwd))


def trailing_anomaly(x: Column, keys: Keys, n: int = 30, min_periods: int = 10,
                     date: str = "date") -> Column:
    """x - trailing mean over the last n days including today, needing min_periods values."""
    w = day_range_window(keys, n - 1, 0, date)
    return x - guarded(F.avg(x), x, w, min_periods)


def seasonal_norm(df: DataFrame, keys: Keys, value: str, years: int = 5,
                  date: str = "date") -> DataFrame:
    """Average of the same day-of-year over the ``years`` prior years, and the deviation."""
    w = (Window.partitionBy(*keys, F.dayofyear(F.col(date))).orderBy(F.year(F.col(date)))
         .rangeBetween(-years, -1))
    return df.select(*keys, date, value,
                     F.avg(F.col(value)).over(w).alias(f"{value}_norm"),
                     (F.col(value) - F.avg(F.col(value)).over(w)).alias(f"{value}_dev"))


# --------------------------------------------------------------------------- W1-W16 column builders

def lag(x: str, n: int, keys: Keys, date: str = "date") -> Column:
    return F.lag(F.col(x), n).over(wspec(keys, date))


def rolling(x: Column, n: int, min_periods: int, fn: str, keys: Keys, shift: int = 1,
            date: str = "date") -> Column:
    """pandas ``x.shift(shift).rolling(n, min_periods).fn()`` on a gap-free spine."""
    w = wspec(keys, date).rowsBetween(-(n + shift - 1), -shift)
    agg = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}[fn](x)
    return guarded(agg, x, w, min_periods)


def streak_columns(df: DataFrame, specs: Sequence[tuple[str, float, str]], keys: Keys,
                   date: str = "date") -> DataFrame:
    """Add one streak column per (source, threshold, name) (W4) using two window passes that
    share the same partitioning and ordering (one exchange)."""
    w = wspec(keys, date)
    staged = df.withColumn("_rn", F.row_number().over(w))
    for src, thr, name in specs:
        staged = staged.withColumn(f"_f_{name}", F.coalesce(F.lag(F.col(src), 1).over(w) > thr,
                                                            F.lit(False)))
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    for src, thr, name in specs:
        last_break = F.max(F.when(~F.col(f"_f_{name}"), F.col("_rn"))).over(wr)
        staged = staged.withColumn(name, (F.col("_rn") - F.coalesce(last_break, F.lit(0))).cast("double"))
    return staged.drop("_rn", *[f"_f_{n}" for _, _, n in specs])


def log_return(p: str, keys: Keys, date: str = "date") -> Column:
    """ln(p) - ln(p lag 1) with zero / negative prices -> NULL."""
    lp = safe_ln(F.col(p))
    return lp - F.lag(lp, 1).over(wspec(keys, date))


# --------------------------------------------------------------------------- feature blocks

def weather_lag_rolling(df: DataFrame, keys: Keys, date: str = "date") -> DataFrame:
    """National HDD / CDD block (W1-W3): lags 1,2,3,7,14; rolling 7 (min 3) and 30 (min 10)
    of the shifted series; 3-day sum (min 2). Temperature lags 1 and 7."""
    cols = [F.col(c) for c in df.columns]
    for src, pre in (("hdd", "hdd"), ("cdd", "cdd")):
        if src not in df.columns:
            continue
        for n in (1, 2, 3, 7, 14):
            cols.append(lag(src, n, keys, date).alias(f"{pre}_lag_{n}"))
        cols.append(rolling(F.col(src), 7, 3, "mean", keys, date=date).alias(f"{pre}_rolling_7"))
        cols.append(rolling(F.col(src), 30, 10, "mean", keys, date=date).alias(f"{pre}_rolling_30"))
        cols.append(rolling(F.col(src), 3, 2, "sum", keys, date=date).alias(f"{pre}_sum_3d"))
    if "temp" in df.columns:
        for n in (1, 7):
            cols.append(lag("temp", n, keys, date).alias(f"temp_lag_{n}"))
    return df.select(*cols)


def target_features(df: DataFrame, keys: Keys, target: str = "target",
                    date: str = "date", trading_days_only: bool = False) -> DataFrame:
    """Target block (W11-W16): lags, SMAs, std, trend deviations, rates of change,
    log-return lags, realised volatility, vol-of-vol and acceleration.

    By default lags count spine rows, so a Monday's lag 1 is the (NULL) Sunday, as in the
    reference (D20); ``trading_days_only=True`` drops NULL-target rows first so lags count
    trading days."""
    if trading_days_only:
        df = df.where(F.col(target).isNotNull())
    w = wspec(keys, date)
    p = F.col(target)
    p1 = F.lag(p, 1).over(w)
    out = df
    cols = [F.col(c) for c in df.columns]
    for n in (1, 2, 3, 5, 7, 14, 30, 60, 90):
        cols.append(F.lag(p, n).over(w).alias(f"target_lag_{n}"))
    sma = {n: rolling(p, n, mp, "mean", keys, date=date) for n, mp in ((7, 3), (30, 10), (90, 30))}
    cols += [sma[7].alias("target_rolling_7"), sma[30].alias("target_rolling_30"),
             sma[90].alias("target_rolling_90"),
             rolling(p, 30, 10, "std", keys, date=date).alias("target_rolling_30_std"),
             rolling(p, 90, 30, "std", keys, date=date).alias("target_rolling_90_std"),
             (p1 - sma[30]).alias("trend_dev_30"), (p1 - sma[90]).alias("trend_dev_90"),
             (sma[7] - sma[30]).alias("trend_sma7_minus_sma30"),
             (sma[30] - sma[90]).alias("trend_sma30_minus_sma90")]
    for n in (7, 30, 90):
        cols.append((F.try_divide(p1, F.lag(p, n + 1).over(w)) - 1.0).alias(f"roc_{n}"))
    out = out.select(*cols, log_return(target, keys, date).alias("_lr"))
    lr1 = F.lag(F.col("_lr"), 1).over(w)
    out = out.withColumn("_lr1", lr1)
    x = F.col("_lr1")
    std30 = rolling(x, 30, 10, "std", keys, shift=0, date=date)
    std90 = rolling(x, 90, 30, "std", keys, shift=0, date=date)
    out = out.select(
        *[F.col(c) for c in out.columns if not c.startswith("_")],
        x.alias("log_return_lag_1"),
        F.lag(x, 1).over(w).alias("log_return_lag_2"),
        F.lag(x, 6).over(w).alias("log_return_lag_7"),
        rolling(F.abs(x), 7, 3, "mean", keys, shift=0, date=date).alias("log_return_abs_rolling_7"),
        rolling(x, 14, 5, "std", keys, shift=0, date=date).alias("log_return_std_14"),
        std30.alias("log_return_std_30"), std90.alias("log_return_std_90"),
        (std30 - std90).alias("log_return_vol_30_minus_90"),
        (x - F.lag(x, 7).over(w)).alias("log_return_accel"),
    )
    return out


# --------------------------------------------------------------------------- J11

def holiday_flag(df: DataFrame, holidays: DataFrame, date: str = "date",
                 holiday_col: str = "holiday") -> DataFrame:
    """is_holiday via a broadcast left-semi membership test (J11). The holiday table is a
    fixed-size list, so the broadcast has a proven size bound."""
    h = F.broadcast(holidays.select(F.col(holiday_col).alias("_h")).distinct())
    return df.join(h, F.col(date) == F.col("_h"), "left").withColumn(
        "is_holiday", F.col("_h").isNotNull().cast("int")).drop("_h")


# --------------------------------------------------------------------------- W17 / J5

def forecast_revisions(snap: DataFrame, keys: Keys, run: str = "run_ts",
                       channel: str = "channel", value: str = "value",
                       version_col: str | None = "version", version: int = 1) -> DataFrame:
    """Revision = value - the same channel's value in the immediately preceding run.

    A channel missing from the preceding run gives NULL (not an older run's value). Two window
    passes and no self-join: the run rank per key (``dense_rank`` over keys) and the channel's
    previous row (``lag`` over keys + channel); the second window's clustering is implied by
    the first one's hash partitioning on the keys, so both share one exchange.
    """
    s = snap.where(F.col(version_col) == version) if version_col else snap
    s = s.withColumn("_rk", F.dense_rank().over(Window.partitionBy(*keys).orderBy(run)))
    w = Window.partitionBy(*keys, channel).orderBy(run)
    prev = F.when(F.lag("_rk").over(w) == F.col("_rk") - 1, F.lag(F.col(value)).over(w))
    out = s.select(*keys, run, channel, value, prev.alias("prev_value"))
    return out.withColumn("revision_1d", F.col(value) - F.col("prev_value"))


# --------------------------------------------------------------------------- J1

def outer_join_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of N daily series on (keys, date) (J1). ``using`` joins coalesce the key
    columns. Each input is already aggregated (hash-partitioned) on exactly these keys, so the
    chain of sort-merge joins reuses that partitioning instead of re-shuffling per join."""
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), frames)


# --------------------------------------------------------------------------- P14

def today_features(history: DataFrame, today: DataFrame, keys: Keys, target: str = "target",
                   date: str = "date") -> DataFrame:
    """Insert the forecast (today) rows into the history and compute the feature row.

    An existing history row on the same (keys, date) is replaced (left-anti), missing columns
    of the today row stay NULL, the features are computed on the gap-free spine, and only the
    today rows are returned (flag column, no join back).
    """
    h = history.join(today.select(*keys, date), [*keys, date], "left_anti").withColumn("_today", F.lit(0))
    t = today.withColumn("_today", F.lit(1))
    u = h.unionByName(t, allowMissingColumns=True).select(*keys, date, target, "temp", "_today")
    p = gap_free_spine(u, keys, [target, "temp", "_today"], date=date)
    w = wspec(keys, date)
    out = p.select(*keys, date, "temp", "_today",
                   F.lag(F.col(target), 1).over(w).alias("target_lag_1"),
                   F.lag(F.col(target), 7).over(w).alias("target_lag_7"),
                   rolling(F.col(target), 7, 3, "mean", keys, date=date).alias("target_rolling_7"),
                   F.lag(F.col("temp"), 1).over(w).alias("temp_lag_1"),
                   hdd(F.col("temp")).alias("hdd"))
    return out.where(F.col("_today") == 1).drop("_today")


def attach_snapshot(df: DataFrame, snapshot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Broadcast a snapshot (one row per ``on`` value, e.g. per as-of date) onto the rows.
    An equi-join on the as-of key rather than a cross join, so many as-of dates work too."""
    return df.join(snapshot, list(on), "left")


# --------------------------------------------------------------------------- P5 / P8 / U3

def trim_window(df: DataFrame, as_of: Column, days: int, date: str = "date") -> DataFrame:
    """Keep ``date >= as_of - days`` (P5). Apply it to each input *after* its fill / window
    stage: a filter on the window's order column must not run before the window, and Catalyst
    does not push a filter on a coalesced key through a full outer join, so trimming each
    input by hand is what keeps the join small."""
    return df.where(F.col(date) >= F.date_sub(as_of, days))


def finite_all(df: DataFrame) -> DataFrame:
    """NaN / +-inf -> NULL on every floating column."""
    from gridcast.functions.scalar import finite
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def years_to_refresh(cache_years: DataFrame, first_year: int, last_year: int,
                     recent: int = 2, year: str = "year") -> DataFrame:
    """Year partitions to re-read for an incremental cache (U3): every year of the wanted
    range missing from the cache, plus the most recent ``recent`` years (late corrections).
    Operates on the distinct cached years (one row per partition)."""
    spark = cache_years.sparkSession
    wanted = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias(year))
    missing = wanted.join(cache_years.select(F.col(year).cast("int")).distinct(), year, "left_anti")
    recent_years = wanted.where(F.col(year) > last_year - recent)
    return missing.unionByName(recent_years).distinct()


# --------------------------------------------------------------------------- P3 / A3

def feature_columns(df: DataFrame, exclude: Sequence[str] = ("target",),
                    keys: Sequence[str] = ("series_id", "date")) -> list[str]:
    """Feature list = every column except keys and leakage columns (P3). Resolved once from the
    schema on the driver; the caller projects with one ``select``."""
    drop = set(exclude) | set(keys)
    return [c for c in df.columns if c not in drop]


def ensure_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Schema-preserving channels (A3): add any missing column as a typed NULL (or a literal
    default given as ``'int:0'``) so downstream feature blocks always find them."""
    out = df
    for name, typ in spec.items():
        if name in out.columns:
            continue
        if ":" in typ:
            t, v = typ.split(":", 1)
            out = out.withColumn(name, F.lit(v).cast(t))
        else:
            out = out.withColumn(name, F.lit(None).cast(typ))
    return out
