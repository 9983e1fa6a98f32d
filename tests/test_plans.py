"""Plan guards: no SQL-path query may plan a nested-loop / cartesian join or a Python UDF node,
and the flagship must prune its scan to the columns it uses."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from plan_audit import summary  # noqa: E402
from gridcast.plans import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL_PATH = sorted(n for n, q in REGISTRY.items()
                  if "bench:skip" not in q.ops and not n.startswith("stream") and n not in
                  ("capped_admission", "landed_series_pages", "forecast_payload_scopes", "panel_corr"))


@pytest.mark.parametrize("name", SQL_PATH)
def test_no_nested_loop_or_python(spark, name):
    plan = REGISTRY[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    s = summary(plan)
    assert s["bnlj"] == 0 and s["python"] == 0, s


def test_flagship_scan_is_pruned(spark):
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY["feature_panel"].build(spark, SF).explain("formatted")
    txt = buf.getvalue()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in txt
