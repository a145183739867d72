"""Rollup queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

#: Lines that a task joins with their orders, on average.
PART = 1_500_000

SCOPE_SQL = """
WITH s AS (
  SELECT l_orderkey, l_suppkey, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) AS d, c_mktsegment, n_name, r_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), f AS (
  SELECT 0 AS scope_order, 'world' AS scope_type, 'world' AS scope_id, * FROM s
  UNION ALL SELECT 1, 'region', r_name, * FROM s
  UNION ALL SELECT 2, 'nation', n_name, * FROM s WHERE l_returnflag <> 'R'
  UNION ALL SELECT 3, 'segment', c_mktsegment, * FROM s WHERE l_returnflag = 'N'
)
SELECT scope_order, scope_type, scope_id, count(*) AS record_count, count(DISTINCT l_orderkey) AS order_count,
       count(DISTINCT l_suppkey) AS supplier_count, count(*) FILTER (WHERE l_returnflag = 'R') AS returned_count,
       CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, min(d) AS first_ship, max(d) AS last_ship
FROM f GROUP BY 1, 2, 3
"""


@query(SCOPE_SQL)
def q_scope_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: every row counts in the scopes that it is eligible for.

    Sums are by (nation, segment, flag), orders by whether they have a line that a scope takes, suppliers by a row each for
    the nations and segments that their lines count in: no row and no aggregate holds a set, and none is wide. Lines meet
    their orders in parts of about PART lines, however many there are.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PART))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    owners = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_nationkey", "c_mktsegment")
    owned = lambda rows: rows.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.repartition(parts, "l_orderkey")
    met = owned(lines)

    flag = F.col("l_returnflag")
    kinds = {"world": F.lit(True), "nation": F.coalesce(flag != "R", F.lit(False)), "segment": F.coalesce(flag == "N", F.lit(False))}
    scopes = {("world", 0): ("world", F.lit("world")), ("region", 1): ("world", F.col("r_name")), ("nation", 2): ("nation", F.col("n_name")), ("segment", 3): ("segment", F.col("c_mktsegment"))}
    keys = ["scope_order", "scope_type", "scope_id"]

    def scoped(rows: DataFrame, taken: Callable[[str, str], Column], *columns: str) -> DataFrame:
        """rows (n_nationkey, c_mktsegment), each in the scopes in which taken(scope, kind of lines) holds."""
        each = [F.when(taken(name, kind), F.struct(F.lit(order).alias("scope_order"), F.lit(name).alias("scope_type"), of.alias("scope_id"))) for (name, order), (kind, of) in scopes.items()]
        return rows.join(F.broadcast(places), "n_nationkey", "left").select(F.explode(F.array_compact(F.array(*each))).alias("s"), *columns).select("s.*", *columns)

    sums = met.groupBy("n_nationkey", "c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(flag == "R").alias("returned"), F.sum("l_quantity").alias("qty"), F.min("d").alias("first"), F.max("d").alias("last"))
    sums = scoped(sums, lambda _, kind: kinds[kind], "n", "returned", "qty", "first", "last").groupBy(*keys).agg(
        F.sum("n").alias("record_count"), F.sum("returned").alias("returned_count"), F.sum("qty").alias("sum_qty"), F.min("first").alias("first_ship"), F.max("last").alias("last_ship")
    )
    has = lines.groupBy("l_orderkey").agg(*[F.bool_or(kinds[k]).alias(k) for k in ("nation", "segment")])
    has = owned(has).groupBy("n_nationkey", "c_mktsegment", "nation", "segment").agg(F.count("*").alias("n"))
    counts = scoped(has, lambda _, kind: F.lit(True) if kind == "world" else F.col(kind), "n").groupBy(*keys).agg(F.sum("n").alias("order_count"))
    side = lambda in_nation, nation, segment: F.struct(F.lit(in_nation).alias("in_nation"), nation.alias("n_nationkey"), segment.alias("c_mktsegment"))
    nowhere, none = (F.lit(None).cast(t) for t in ("int", "string"))
    sides = F.array_compact(F.array(side(True, F.col("n_nationkey"), none), F.when(kinds["segment"], side(False, nowhere, F.col("c_mktsegment")))))
    who = met.select("l_suppkey", kinds["nation"].alias("eligible"), F.explode(sides).alias("x")).groupBy("x.in_nation", "x.n_nationkey", "x.c_mktsegment", "l_suppkey").agg(F.bool_or("eligible").alias("eligible"))
    who = scoped(who, lambda name, _: ~F.col("in_nation") if name == "segment" else F.col("in_nation") & (F.col("eligible") if name == "nation" else F.lit(True)), "l_suppkey")
    who = who.distinct().groupBy(*keys).agg(F.count("l_suppkey").alias("supplier_count"))
    out = sums
    for more in (counts, who):  # a scope's id may be null
        order, kind, of, value = more.columns
        more = more.toDF("__order", kind, "__of", value).drop(kind)
        out = out.join(more, (F.col("scope_order") == F.col("__order")) & F.col("scope_id").eqNullSafe(F.col("__of"))).drop("__order", "__of")
    return out.select(*keys, "record_count", "order_count", "supplier_count", "returned_count", "sum_qty", "first_ship", "last_ship")
