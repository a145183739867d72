"""Functions of the catalogue, hexagonal cells, canonical numbers and archives over the star tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import hexgrid
from sedimenta.functions.text import jcs, json_number, json_text
from sedimenta.operators.catalogue import review_catalogue
from sedimenta.session import fresh_dir
from sedimenta.sources.archives import read_zip_ranges, write_zip_csv

from .registry import query, table


def _review(spark: SparkSession, sf_dir: str) -> None:
    review_catalogue(spark, *[table(spark, sf_dir, t) for t in ("customer", "nation", "orders")])


@query("""
SELECT r.role, c_custkey, c_mktsegment, n_name, CASE WHEN r.role = 'administrator' OR c_acctbal >= 0 THEN c_acctbal END AS balance
FROM (VALUES ('administrator', 9), ('curator', 2), ('guest', -1)) r(role, upto), customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= upto
""")
def q_role_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role sees, by one predicate that a table function calls with the caller's role."""
    _review(spark, sf_dir)
    return spark.sql(" UNION ALL ".join(f"SELECT '{r}' AS role, * FROM visible_customers('{r}')" for r in ("administrator", "curator", "guest")))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, coalesce(bool_and(o_orderstatus = 'F'), FALSE) AS complete
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1 GROUP BY c_custkey
""")
def q_progress_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress of a region's customers, as a table function."""
    _review(spark, sf_dir)
    return spark.sql("SELECT * FROM customer_progress(1)")


RES = 4
LON, LAT = "(c_custkey * 37 % 36000) / 100.0 - 180", "(c_custkey * 91 % 17000) / 100.0 - 85"
_Z, _BACK = hexgrid._scale(RES), 1 / hexgrid._scale(RES)


@query(f"""
WITH p AS (SELECT c_custkey, radians({LON}) AS a, sin(radians({LAT})) AS b FROM customer),
w AS (SELECT c_custkey, a * {_Z.real!r} - b * {_Z.imag!r} AS x, a * {_Z.imag!r} + b * {_Z.real!r} AS y FROM p),
f AS (SELECT c_custkey, x - y * {1 / math.sqrt(3)!r} AS q, y * {2 / math.sqrt(3)!r} AS r FROM w),
g AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM f),
e AS (SELECT *, abs(rq - q) AS eq, abs(rr - r) AS er, abs(rs + q + r) AS es FROM g),
c AS (SELECT c_custkey, CASE WHEN eq > er AND eq > es THEN -rr - rs ELSE rq END::BIGINT AS q, CASE WHEN eq > er AND eq > es THEN rr WHEN er > es THEN -rq - rs ELSE rr END::BIGINT AS r FROM e),
u AS (SELECT *, floor((2 * (3 * q + r) + 7) / 14)::BIGINT AS pq, floor((2 * (2 * r - q) + 7) / 14)::BIGINT AS pr, q + r * 0.5 AS cx, r * {math.sqrt(3) / 2!r} AS cy FROM c)
SELECT c_custkey, concat_ws(':', {RES}, q, r) AS cell, concat_ws(':', {RES - 1}, pq, pr) AS parent, round(degrees(cx * {_BACK.real!r} - cy * {_BACK.imag!r}), 5) AS lon,
  round(degrees(asin(greatest(-1, least(1, cx * {_BACK.imag!r} + cy * {_BACK.real!r})))), 5) AS lat FROM u
""")
def q_hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hexagonal cells of points made from customers, with parents and centres."""
    points = table(spark, sf_dir, "customer").select("c_custkey", F.expr(LON).cast("double").alias("lon"), F.expr(LAT).cast("double").alias("lat"))
    cells = points.select("c_custkey", hexgrid.cell(F.col("lon"), F.col("lat"), RES).alias("c")).select("c_custkey", "c", hexgrid.centre(F.col("c"), RES).alias("m"))
    return cells.select("c_custkey", hexgrid.name(F.col("c")).alias("cell"), hexgrid.name(hexgrid.parent(F.col("c"))).alias("parent"), F.round("m.lon", 5).alias("lon"), F.round("m.lat", 5).alias("lat"))


@query("""
WITH n AS (
  SELECT o_orderkey, regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') AS price, regexp_replace((o_totalprice / 7)::VARCHAR, '\\.0$', '') AS share,
    '"' || o_orderpriority || '"' AS priority FROM orders)
SELECT o_orderkey, '{"key":' || o_orderkey || ',"price":' || price || ',"priority":' || priority || ',"share":' || share || '}' AS json,
  sha256('{"key":' || o_orderkey || ',"price":' || price || ',"priority":' || priority || ',"share":' || share || '}' || chr(10)) AS fingerprint FROM n
""")
def q_canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the canonical JSON of an order, with its price and a quotient of up to 17 digits, and its fingerprint."""
    price = F.col("o_totalprice")
    text = jcs(key=F.col("o_orderkey").cast("string"), price=json_number(price), share=json_number(price / 7), priority=json_text(F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("json"))
    return rows.withColumn("fingerprint", F.sha2(F.concat("json", F.lit("\n")), 256))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def q_archive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to ZIP archives by tasks and read back by byte ranges, with the columns asked for only."""
    at = fresh_dir(spark, "archives")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string"), "o_orderpriority")
    write_zip_csv(orders.repartition(4, "o_orderkey"), at)
    back = read_zip_ranges(spark, at, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], range_bytes=1 << 18)
    return back.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), F.col("o_totalprice").cast("double"), "o_orderpriority")
