"""Print a one-line physical-plan summary per registered query: shuffles, broadcasts, single-
partition exchanges, nested-loop / cartesian joins, Python evaluation nodes, scan pruning."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single": plan.count("SinglePartition"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)),
        "scans": plan.count("FileScan parquet"),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
    }


def main():
    from gridcast.plans import REGISTRY
    from gridcast.session import local_session
    spark = local_session(8)
    sf = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.01")
    skip = ("bench:skip",)
    for n, q in REGISTRY.items():
        if any(s in q.ops for s in skip) and n.startswith("stream"):
            continue
        if "bench:skip" in q.ops:
            continue
        df = q.build(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(n, summary(plan))


if __name__ == "__main__":
    main()
