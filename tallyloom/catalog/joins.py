"""Joins and the key audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code_decode, sentinel_flag
from ..operators import enrich_detail, fanout_audit, join_inner, join_left, left_join_default
from ..plans.standin import table
from .registry import query

_KEYS = ["l_orderkey", "l_linenumber"]


@query(
    "join_inner_composite",
    """WITH one AS (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS first_part FROM lineitem
                    WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_linenumber)
       SELECT l_orderkey, l_linenumber, l_quantity, first_part FROM lineitem JOIN one USING (l_orderkey, l_linenumber)""",
)
def join_inner_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems whose (order, line) has a finished row, with that row's first part."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.where("l_linestatus = 'F'").select(*_KEYS, F.col("l_partkey").alias("first_part"))
    return join_inner(lines.select(*_KEYS, "l_quantity"), one, _KEYS, duplicates="dedupe")


@query(
    "join_left_outer",
    """SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
)
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their lines: rows multiply, and orders without lines stay."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"
    )
    return join_left(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])


@query(
    "join_enrich_detail",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderdate AS ordered, o.o_custkey AS customer,
              CAST(s.s_nationkey AS VARCHAR) AS supplier_nation,
              CASE WHEN s.s_name = '#NULO#' THEN 0 ELSE 1 END AS spare,
              CASE s.s_nationkey WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 END AS origin
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
            LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 5000) s ON s.s_suppkey = l.l_suppkey""",
)
def join_enrich_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal >= 5000").withColumnRenamed("s_suppkey", "l_suppkey")
    return enrich_detail(
        lines,
        orders,
        ["l_orderkey"],
        rich,
        ["l_suppkey"],
        {"ordered": "o_orderdate", "customer": "o_custkey"},
        {
            "supplier_nation": F.col("extra.s_nationkey").cast("string"),
            "spare": sentinel_flag("extra.s_name"),
            "origin": code_decode("extra.s_nationkey", {0: 10, 1: 11, 2: 12}),
        },
    ).drop("l_suppkey")


@query(
    "fanout_audit",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)
def q_fanout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout_audit(table(spark, sf_dir, "lineitem"), _KEYS)


@query(
    "left_join_default",
    """SELECT o_orderkey, o_custkey, COALESCE(n_lines, 0) AS n_lines, COALESCE(quantity, 0) AS quantity,
              CASE WHEN n_lines IS NOT NULL THEN 1 ELSE 0 END AS has_lines
       FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
                              FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q_left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return left_join_default(orders, sums, ["o_orderkey"], {"n_lines": 0, "quantity": 0}, {"has_lines": "n_lines"})
