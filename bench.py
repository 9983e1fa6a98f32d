"""Bench: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON
line {"metric", "value", "unit", "queries", "sf"}.

Each query is executed in full with the ``noop`` sink (every row is produced, nothing is
collected to the driver). One warm-up query absorbs JVM start-up; every query is then timed
once. ``value`` is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from gridcast.session import local_session
    from gridcast.plans import REGISTRY

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="gridcast-bench")
    with_ml = os.environ.get("BENCH_ML", "0") == "1"
    names = [n for n, q in REGISTRY.items()
             if (not only or n in only) and (with_ml or "bench:skip" not in q.ops)]
    # warm-up (JIT, class loading, parquet footers)
    REGISTRY["feature_panel"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        try:
            REGISTRY[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001
            print(f"bench: {n} failed: {str(exc)[:300]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "registered_queries_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "n_queries": len(times), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
