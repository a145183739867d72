"""SQL functions of the session: predicates that views call with the caller's role, and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def define_scalar(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A temporary SQL function; its body is an expression or a scalar subquery in brackets."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def define_table(spark: SparkSession, name: str, arguments: str, columns: str, body: str) -> None:
    """A temporary SQL table function; its body is a query."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def review_catalogue(spark: SparkSession, customer: DataFrame, nation: DataFrame, orders: DataFrame) -> None:
    """Functions over three tables: may_see(role, region), balance_for(role, balance), visible_customers(role), customer_progress(region).

    An administrator sees all; a curator sees the regions 0 to 2, without balances below zero; any other role sees
    nothing. A null role is another role, a null region is seen by administrators only.
    """
    customer.createOrReplaceTempView("sedimenta_customer")
    nation.createOrReplaceTempView("sedimenta_nation")
    orders.createOrReplaceTempView("sedimenta_orders")
    define_scalar(spark, "may_see", "role STRING, region INT", "BOOLEAN", "role IS NOT NULL AND (role = 'administrator' OR (role = 'curator' AND region IS NOT NULL AND region <= 2))")
    define_scalar(spark, "balance_for", "role STRING, balance DOUBLE", "DOUBLE", "CASE WHEN role = 'administrator' OR balance >= 0 THEN balance END")
    define_table(
        spark, "visible_customers", "role STRING", "c_custkey BIGINT, c_mktsegment STRING, n_name STRING, balance DOUBLE",
        "SELECT c_custkey, c_mktsegment, n_name, balance_for(visible_customers.role, c_acctbal) FROM sedimenta_customer JOIN sedimenta_nation ON c_nationkey = n_nationkey WHERE may_see(visible_customers.role, n_regionkey)",
    )
    define_table(
        spark, "customer_progress", "region INT", "c_custkey BIGINT, n_orders BIGINT, n_open BIGINT, complete BOOLEAN",
        "SELECT c_custkey, count(o_orderkey), count_if(o_orderstatus = 'O'), coalesce(bool_and(o_orderstatus = 'F'), false) FROM sedimenta_customer JOIN sedimenta_nation ON c_nationkey = n_nationkey "
        "LEFT JOIN sedimenta_orders ON o_custkey = c_custkey WHERE n_regionkey = customer_progress.region GROUP BY c_custkey",
    )
