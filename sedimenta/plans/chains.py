"""Chains, tree orders and ranges below a node, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.operators.graph import chains, contained, preorder, totals_below, tree_faults
from sedimenta.operators.ordering import placed
from sedimenta.session import materialize

from .registry import query, table


@query("""
SELECT o_orderkey AS node, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth, 'rooted' AS state
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def q_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order supersedes its customer's one before; the chain's first order and the place in it, by doubling."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), before.alias("parent"))
    return chains(materialize(links, "links"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (node, parent): a world of regions, their nations, and each nation's suppliers and customers."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    world = spark.range(1).select(F.lit("W").alias("node"), F.lit(None).cast("string").alias("parent"))
    under = t("region").select(node("R", "r_regionkey"), F.lit("W")).union(t("nation").select(node("N", "n_nationkey"), node("R", "n_regionkey")))
    return world.union(under).union(t("supplier").select(node("S", "s_suppkey"), node("N", "s_nationkey"))).union(t("customer").select(node("C", "c_custkey"), node("N", "c_nationkey")))


PLACES = """
a AS (SELECT 'W' AS node, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'W' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
t AS (SELECT node, parent, [node] AS path FROM a WHERE parent IS NULL UNION ALL SELECT a.node, a.parent, list_append(t.path, a.node) FROM a JOIN t ON a.parent = t.node),
u AS (SELECT node, unnest(path) AS top FROM t)
"""


@query(f"""
WITH RECURSIVE {PLACES}, s AS (SELECT top, count(*) AS size FROM u GROUP BY 1)
SELECT t.node, parent, row_number() OVER (ORDER BY path) - 1 AS pre, size, len(path)::BIGINT - 1 AS depth FROM t JOIN s ON t.node = s.top
""")
def q_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first numbers, subtree sizes and depths of the tree of places, by ranking a tour."""
    return preorder(places(spark, sf_dir))


@query(f"""
WITH RECURSIVE {PLACES}, f AS (SELECT 'S' || l_suppkey AS node, count(*) AS n_lines, 0 AS n_orders FROM lineitem GROUP BY 1 UNION ALL SELECT 'C' || o_custkey, 0, count(*) FROM orders GROUP BY 1)
SELECT top AS node, coalesce(sum(n_lines), 0)::BIGINT AS n_lines, coalesce(sum(n_orders), 0)::BIGINT AS n_orders FROM u LEFT JOIN f USING (node) GROUP BY 1
""")
def q_subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders of every place and all below it, as differences of a running total along the tree's order."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node"), one.alias("n_lines"), none.alias("n_orders"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node"), none.alias("n_lines"), one.alias("n_orders"))
    return totals_below(preorder(places(spark, sf_dir)), lines.union(orders), ["n_lines", "n_orders"])


@query(f"WITH RECURSIVE {PLACES} SELECT top AS definition, node AS place FROM u WHERE top[1] IN ('R', 'N') AND node[1] IN ('S', 'C')")
def q_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition at a region or nation links to all suppliers and customers below it, by a range join of intervals."""
    tree = materialize(preorder(places(spark, sf_dir)), "tree")
    above = tree.where("substring(node, 1, 1) IN ('R', 'N')").select(F.col("node").alias("definition"), F.col("pre").alias("low"), (F.col("pre") + F.col("size")).alias("high"))
    below = tree.where("substring(node, 1, 1) IN ('S', 'C')").select(F.col("node").alias("place"), F.col("pre").alias("at"))
    return contained(above, below).select("definition", "place")


@query("""
WITH a AS (SELECT doc_id AS node, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before, quality FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT node, CASE WHEN quality = 0 THEN -node - 1 ELSE before END AS parent FROM a), r AS (SELECT count(*) AS n FROM l WHERE parent IS NULL)
SELECT CASE WHEN n = 0 THEN 'no_root' ELSE 'several_roots' END AS fault, n FROM r WHERE n <> 1
UNION ALL SELECT 'missing_parent', count(*) FROM (
  SELECT max(quality = 0) OVER (PARTITION BY source ORDER BY doc_id) AS lost FROM documents LEFT JOIN labels USING (doc_id)) WHERE lost HAVING count(*) > 0
""")
def q_tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source follow each other, those of bad quality follow a document that isn't there; what keeps this from being a tree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("bad"))
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    links = docs.select("doc_id", before.alias("before")).join(bad, "doc_id", "left")
    return tree_faults(materialize(links.select(F.col("doc_id").alias("node"), F.when(F.col("bad"), -F.col("doc_id") - 1).otherwise(F.col("before")).alias("parent")), "links"))


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_type <> 'ECONOMY', p_type, p_name, p_partkey) AS place FROM part
""")
def q_pack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every part in one order of several keys, over range-sorted partitions instead of one window."""
    keys = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_type") != "ECONOMY").alias("other"), "p_type", "p_name")
    return placed(keys, ["p_size", "other", "p_type", "p_name", "p_partkey"]).select("p_partkey", F.col("place").cast("long"))
