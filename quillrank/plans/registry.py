"""Query registry: every query is a (spark, sf_dir) -> DataFrame callable,
optionally paired with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (the oracle rounds the same columns)."""
    # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines print zero alike.
    return df.select(*[
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"
