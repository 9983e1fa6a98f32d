"""Registry of named queries: each has a Spark builder and (when SQL-expressible) a DuckDB
oracle. Output doubles are rounded to 6 decimals on both sides so summation order does not
decide the value hash."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # +1e-9 moves exact decimal ties (common: cents / 4000) off the tie, so a 1-ulp
            # summation-order difference cannot round the two engines in opposite directions
            cols.append(F.round(F.col(f.name) + F.lit(1e-9), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(sql: str, doubles: list[str], places: int = 6) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c} + 1e-9, {places}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None, doubles: list[str] | None = None, ops: str = ""):
    def deco(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        full_sql = sql_round(sql, list(doubles or [])) if sql is not None else None
        REGISTRY[name] = Query(name, build, full_sql, list(doubles or []), ops)
        return fn
    return deco
