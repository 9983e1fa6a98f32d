"""Registered queries (Spark builders + DuckDB oracle SQL)."""

from gridcast.plans import q_timeseries  # noqa: F401  (registers queries)
from gridcast.plans.registry import REGISTRY

_MODULES = ["q_features", "q_quotes", "q_ledger", "q_metrics", "q_learn", "q_stream", "q_sources", "q_sinks"]
for _m in _MODULES:
    try:
        __import__(f"gridcast.plans.{_m}")
    except ModuleNotFoundError as exc:  # modules land one by one
        if exc.name != f"gridcast.plans.{_m}":
            raise


def queries():
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
