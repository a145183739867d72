"""Small given tables: the same rows as a DataFrame and as a SQL table, for queries that test a domain rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


@dataclass(frozen=True)
class Given:
    """name, schema ("a string, b long") and rows."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """The table as a common table expression."""
        columns = [c.strip().rsplit(" ", 1) for c in self.schema.split(",")]
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"c{i}::{TYPES[kind]} AS {name}" for i, (name, kind) in enumerate(columns))
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(columns)))}))"


def over(*tables: Given, then: str) -> str:
    """A query over given tables; `then` goes on after their expressions, with a comma or SELECT."""
    return f"WITH {', '.join(t.sql for t in tables)} {then}"
