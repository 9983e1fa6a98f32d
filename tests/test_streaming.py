import datetime as dt
import time

from gridcast.session import scratch_path
from gridcast.streaming import streams as xs

SCHEMA = ("event_id bigint, series_ticker string, ticker string, status string, yes_ask string, "
          "yes_ask_dollars string, last_price_dollars string, yes_bid_dollars string, volume string, "
          "volume_fp string, ts timestamp_ntz")


def _rows(spark, items):
    return spark.createDataFrame([(i, s, f"{s}-{i}", "open", str(a), None, None, None, "1", None, t)
                                  for i, (s, a, t) in enumerate(items)], SCHEMA)


def test_watermark_drops_late_rows_and_updates_in_window(spark):
    """Spark drops a row older than the watermark of the previous micro-batch (late-event
    watermark); rows within the watermark delay are always aggregated and merged through the
    upsert log."""
    d = lambda day, h=12: dt.datetime(2024, 1, day, h)
    landing = scratch_path(spark, "test-x1")
    files = [[("s", 10, d(1)), ("s", 20, d(3)), ("s", 30, d(5))],
             [("s", 40, d(5, 13)), ("s", 60, d(6))],
             [("s", 90, d(1)), ("s", 70, d(6, 13))]]
    for i, f in enumerate(files):
        _rows(spark, f).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)   # the file source orders files by modification time
    stream = xs.folder_stream(spark, landing, _rows(spark, []).schema, max_files_per_trigger=1)
    out = {r["day"]: (r["n_open"], r["max_prob"]) for r in xs.run_windowed_snapshot(spark, stream).collect()}
    assert out[dt.date(2024, 1, 1)] == (1, 0.1)      # the day-1 row of batch 3 is dropped as late
    assert out[dt.date(2024, 1, 5)] == (2, 0.4)      # in-window update merged through the upsert log
    assert out[dt.date(2024, 1, 6)] == (2, 0.7)


RUNS = "series_id string, run_ts date, channel string, version int, value double"


def _land(spark, landing, rows, schema=RUNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    time.sleep(1.1)   # the file source orders files by modification time


def _day(n, month=1):
    return dt.date(2024, month, n)


def test_revisions_gather_a_run_from_several_batches(spark):
    """A run split over micro-batches, an older run that arrives within the delay, one that arrives
    after it was closed, repeated rows and nulls."""
    from gridcast.operators.timeseries import forecast_revisions
    files = [
        [("s", _day(1), "a", 1, 1.0), ("t", _day(1), "a", 1, 7.0)],
        [("s", _day(1), "b", 1, 5.0)],                                  # the rest of the first run
        [("s", _day(3), "a", 1, 2.0), ("t", _day(3), "a", 1, 9.0)],
        [("s", _day(2), "b", 1, 99.0), ("s", _day(3), "c", 1, None), ("s", _day(3), "c", 1, 3.0)],   # late, still open
        [("s", _day(9), "a", 1, 4.0), ("s", _day(9), "b", 1, 8.0)],
        [("t", _day(9), "a", 1, 3.0)],                                  # the batch in which the timers run
        [("s", _day(2), "a", 1, 50.0), ("s", _day(9), "c", 1, 1.0), ("s", _day(9), "d", 2, 1.0)],    # closed by now
    ]
    landing = scratch_path(spark, "test-x4")
    for f in files:
        _land(spark, landing, f)
    stream = xs.folder_stream(spark, landing, spark.createDataFrame([], RUNS).schema, max_files_per_trigger=1)
    kept = [r for f in files for r in f if r not in (("s", _day(2), "a", 1, 50.0), ("s", _day(3), "c", 1, None))]
    whole = spark.createDataFrame(kept, RUNS)
    xs.heartbeat(whole).coalesce(1).write.mode("append").parquet(landing)
    got = sorted(tuple(r) for r in xs.run_stream_revisions(spark, stream, delay_days=2).collect())
    assert got == sorted(tuple(r) for r in forecast_revisions(whole, ["series_id"]).collect())


def test_revisions_go_on_after_a_restart(spark):
    from gridcast.operators.timeseries import forecast_revisions
    landing, path, ckpt = (scratch_path(spark, n) for n in ("test-x4b", "test-x4b-out", "test-x4b-ckpt"))
    schema = spark.createDataFrame([], RUNS).schema
    first = [("s", _day(1), "a", 1, 1.0), ("s", _day(4), "a", 1, 2.0)]
    second = [("s", _day(4), "b", 1, 6.0), ("s", _day(8), "a", 1, 5.0), ("s", _day(8), "b", 1, 9.0)]
    _land(spark, landing, first)
    a = xs.run_stream_revisions(spark, xs.folder_stream(spark, landing, schema), path=path, checkpoint=ckpt).collect()
    assert [tuple(r)[1:4] for r in a] == [(_day(1), "a", 1.0)]          # the later run is still open
    _land(spark, landing, second)
    whole = spark.createDataFrame(first + second, RUNS)
    xs.heartbeat(whole).coalesce(1).write.mode("append").parquet(landing)
    b = xs.run_stream_revisions(spark, xs.folder_stream(spark, landing, schema), path=path, checkpoint=ckpt).collect()
    assert sorted(tuple(r) for r in b) == sorted(tuple(r) for r in forecast_revisions(whole, ["series_id"]).collect())


def test_partition_upsert_across_batches(spark):
    schema = "station_id int, date date, temp double, src string"
    cache = spark.createDataFrame([(1, dt.date(2023, 12, 31), 1.0, "cache"), (1, dt.date(2024, 1, 1), 2.0, "cache"),
                                   (2, dt.date(2024, 1, 1), 3.0, "cache")], schema)
    landing = scratch_path(spark, "test-x3")
    for r in ([(1, dt.date(2024, 1, 1), 20.0, "b1")], [(1, dt.date(2024, 1, 1), 21.0, "b2"),
                                                       (3, dt.date(2024, 2, 1), 5.0, "b2")]):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    stream = xs.folder_stream(spark, landing, cache.schema, max_files_per_trigger=1)
    got = sorted(tuple(r) for r in xs.run_stream_upsert(spark, cache, stream, ["station_id", "date"])
                 .select("station_id", "date", "temp", "src").collect())
    assert got == [(1, dt.date(2023, 12, 31), 1.0, "cache"), (1, dt.date(2024, 1, 1), 21.0, "b2"),
                   (2, dt.date(2024, 1, 1), 3.0, "cache"), (3, dt.date(2024, 2, 1), 5.0, "b2")]
