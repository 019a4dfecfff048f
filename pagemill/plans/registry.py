"""Query catalogue: every registered query is a Spark plan over the base
tables plus (when SQL-expressible) the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}   # query name → SURVEY §2 operator ids it covers


def register(name: str, ops: str, oracle: str | Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = ops
        if oracle is not None:
            ORACLES[name] = oracle() if callable(oracle) else oracle
        return fn

    return deco
