"""Queries by name, each with its SQL twin or None; rules by name, which read rows given with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rules over given rows: cases for tests, no queries over tables.
RULES: dict[str, Query] = {}
RULE_ORACLES: dict[str, str] = {}


def _put_in(queries: dict[str, Query], oracles: dict[str, str], sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        queries[f.__name__] = f
        if sql is not None:
            oracles[f.__name__] = sql
        return f

    return put


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""
    return _put_in(QUERIES, ORACLES, sql)


def rule(sql: str | None = None) -> Callable[[Query], Query]:
    """The same for a rule over given rows."""
    return _put_in(RULES, RULE_ORACLES, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
