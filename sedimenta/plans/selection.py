"""Selection under shared caps and partitions by count, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.planning import pyramid_partitions
from sedimenta.operators.sampling import round_robin_quota

from .registry import query, table


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as media: the part is the species, the order the observation, the supplier the observer, the price the rank."""
    line = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("part"), "l_orderkey", F.col("l_suppkey").cast("string").alias("supplier"), line.alias("line"), "l_extendedprice")


#: Lines of a part, and of a supplier over all parts.
PER_PART, PER_SUPPLIER = 5, 115


@query()
def q_reference_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to PER_PART lines of each part, turn by turn, up to PER_SUPPLIER of a supplier over all parts."""
    return round_robin_quota(offered(spark, sf_dir), "part", "l_orderkey", "supplier", "line", [F.col("l_extendedprice").desc()], PER_PART, PER_SUPPLIER)


SECONDS, VALUES, HALVINGS, CAP = (1704067200, 1704067200 + 30 * 86400 - 1), (0.0, 1024.0), 6, 40


@query(f"""
WITH RECURSIVE p AS (
  SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t, value AS v, '' AS path, {SECONDS[0]}::BIGINT AS a, {SECONDS[1]}::BIGINT AS b, {VALUES[0]}::DOUBLE AS c, {VALUES[1]}::DOUBLE AS d, 0 AS halvings
  FROM events WHERE epoch(date_trunc('second', ts)) BETWEEN {SECONDS[0]} AND {SECONDS[1]} AND value BETWEEN {VALUES[0]} AND {VALUES[1]}
  UNION ALL
  SELECT event_id, t, v, path || CASE WHEN CASE WHEN a < b THEN t > mid ELSE v > half END THEN '1' ELSE '0' END, CASE WHEN a < b AND t > mid THEN mid + 1 ELSE a END, CASE WHEN a < b AND t <= mid THEN mid ELSE b END,
    CASE WHEN a >= b AND v > half THEN half ELSE c END, CASE WHEN a >= b AND v <= half THEN half ELSE d END, CASE WHEN a < b THEN 0 ELSE halvings + 1 END
  FROM (SELECT *, a + (b - a) // 2 AS mid, (c + d) / 2 AS half FROM p) WHERE a < b OR halvings < {HALVINGS}
), n AS (SELECT path, a, b, c, d, halvings, count(*) AS n FROM p GROUP BY ALL)
SELECT x.path, x.n, x.a AS from_s, x.b AS to_s, x.c AS low, x.d AS high, CASE WHEN x.n < {CAP} THEN 'fits' ELSE 'saturated' END AS state
FROM n x LEFT JOIN n y ON x.path <> '' AND y.path = left(x.path, length(x.path) - 1)
WHERE (x.n < {CAP} AND coalesce(y.n >= {CAP}, TRUE)) OR (x.n >= {CAP} AND x.a = x.b AND x.halvings = {HALVINGS})
""")
def q_event_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of time and value with fewer than CAP events, from one count of the smallest boxes."""
    events = table(spark, sf_dir, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "value")
    return pyramid_partitions(events, "second", "value", SECONDS, VALUES, HALVINGS, CAP)
