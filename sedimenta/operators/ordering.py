"""Total orders over partitions: places and running totals of rows that are range-sorted, so that no task holds all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.session import materialize


def _ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in a table, with __part: the number of the range of keys that a row lies in."""
    return materialize(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")


def _before(sums: DataFrame, columns: list[str]) -> DataFrame:
    """Sums by __part to what stands before each part: a row a partition, so never more than the sort has."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__before_{c}") for c in columns])


def placed(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the order of keys; nulls come first. Keys that tie have places in any order."""
    rows = _ranges(df, keys)
    before = _before(rows.groupBy("__part").agg(F.count("*").alias("rows")), ["rows"])
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return rows.join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before_rows")).drop("__part", "__before_rows")


def running_totals(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """df with total_<value>: the sum of a value up to each row and including it, in the order of keys, which are unique."""
    rows = _ranges(df, keys)
    before = _before(rows.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values]), values)
    w = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"total_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"__before_{v}") for v in values}
    return rows.join(F.broadcast(before), "__part").withColumns(totals).drop("__part", *[f"__before_{v}" for v in values])
