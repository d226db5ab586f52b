"""Derived columns, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    before_cutoff_flag,
    cast_codes,
    code_decode,
    composite_key,
    drop_columns,
    equals_flag,
    filter_equal,
    floor_positive_columns,
    list_item_count,
    member_bucket,
    null_audit,
    null_to,
    parse_date_time,
    parse_timestamp,
    present_flag,
    range_bucket,
    sentinel_flag,
    sentinel_to_null,
)
from ..functions.derive import DATE_MINUTE
from ..plans.standin import table
from .registry import query


@query(
    "composite_key",
    """SELECT l_linenumber, l_returnflag,
              CONCAT_WS('-', l_orderkey, l_linenumber, l_suppkey) AS line_id,
              CONCAT_WS('-', l_orderkey, l_linenumber) AS order_line_id
       FROM lineitem""",
)
def q_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        "l_returnflag",
        composite_key("l_orderkey", "l_linenumber", "l_suppkey").alias("line_id"),
        composite_key("l_orderkey", "l_linenumber").alias("order_line_id"),
    )


@query("project_drop", "SELECT p_partkey, p_name, p_size FROM part")
def project_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_columns(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_retailprice", "not_there"])


@query(
    "cast_codes",
    "SELECT l_linenumber, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, "
    "CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem",
)
def q_cast_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    return cast_codes(rows, ["l_orderkey", "l_partkey", "l_suppkey"])


@query(
    "range_bucket",
    """SELECT p_partkey,
              CASE WHEN p_partkey BETWEEN 100 AND 299 THEN 2009 WHEN p_partkey BETWEEN 300 AND 449 THEN 2010
                   WHEN p_partkey BETWEEN 500 AND 699 THEN 2011 WHEN p_partkey BETWEEN 900 AND 1299 THEN 2013
                   WHEN p_partkey BETWEEN 1500 AND 1899 THEN 2020 ELSE 1 END AS model
       FROM part""",
)
def q_range_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [(100, 299, 2009), (300, 449, 2010), (500, 699, 2011), (900, 1299, 2013), (1500, 1899, 2020)]
    return table(spark, sf_dir, "part").select("p_partkey", range_bucket("p_partkey", ranges, 1).alias("model"))


@query(
    "member_bucket",
    """SELECT n_name,
              CASE WHEN n_name IN ('NATION_0', 'NATION_4', 'NATION_7') THEN 'SE'
                   WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'S'
                   WHEN n_name = 'NATION_24' THEN 'ZZ' ELSE 'NE' END AS area
       FROM nation""",
)
def q_member_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"SE": ["NATION_0", "NATION_4", "NATION_7"], "S": ["NATION_1", "NATION_2"], "ZZ": ["NATION_24"]}
    return table(spark, sf_dir, "nation").select("n_name", member_bucket("n_name", groups, "NE").alias("area"))


@query(
    "parse_timestamps",
    """WITH t AS (
         SELECT event_id,
                CASE WHEN event_type = 'error' THEN '#NULO#' ELSE STRFTIME(ts, '%d/%m/%Y %H:%M:%S') END AS whole,
                CASE WHEN event_type = 'click' THEN '#NULO#' ELSE STRFTIME(ts, '%d/%m/%Y %H:%M') END AS minute,
                CASE WHEN event_type = 'signup' THEN NULL ELSE STRFTIME(ts, '%d/%m/%Y') END AS day,
                STRFTIME(ts, '%H:%M:%S') AS clock
         FROM events)
       SELECT event_id,
              TRY_STRPTIME(whole, '%d/%m/%Y %H:%M:%S') AS whole_ts,
              STRFTIME(TRY_STRPTIME(minute, '%d/%m/%Y %H:%M'), '%Y-%m-%d %H:%M:%S') AS minute_text,
              STRFTIME(TRY_STRPTIME(day || ' ' || clock, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS joined_text,
              STRFTIME(TRY_STRPTIME(CONCAT_WS(' ', day, clock), '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS skipped_text
       FROM t""",
)
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "#NULO#")
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .alias("whole"),
        F.when(F.col("event_type") == "click", "#NULO#")
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .alias("minute"),
        F.when(F.col("event_type") != "signup", F.date_format("ts", "dd/MM/yyyy")).alias("day"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
    )
    shown = "yyyy-MM-dd HH:mm:ss"
    return text.select(
        "event_id",
        parse_timestamp("whole").alias("whole_ts"),
        F.date_format(parse_timestamp("minute", DATE_MINUTE), shown).alias("minute_text"),
        F.date_format(parse_date_time("day", "clock"), shown).alias("joined_text"),
        F.date_format(parse_date_time("day", "clock", skip_nulls=True), shown).alias("skipped_text"),
    )


_MARKED = "CASE WHEN o_orderpriority = '3-MEDIUM' THEN '#NULO#' WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority holds the sentinel for one value and NULL for some rows."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "#NULO#")
        .when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
        .alias("mark"),
    )


@query(
    "sentinel_flag",
    f"""WITH t AS (SELECT o_orderkey, {_MARKED} AS mark FROM orders)
        SELECT o_orderkey, CASE WHEN mark = '#NULO#' THEN 0 ELSE 1 END AS flag,
               CASE WHEN mark = '#NULO#' THEN 0 WHEN mark IS NOT NULL THEN 1 END AS flag_or_null FROM t""",
)
def q_sentinel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select(
        "o_orderkey",
        sentinel_flag("mark").alias("flag"),
        sentinel_flag("mark", unmatched="null").alias("flag_or_null"),
    )


@query(
    "sentinel_to_null",
    f"WITH t AS (SELECT o_orderkey, {_MARKED} AS mark FROM orders) "
    "SELECT o_orderkey, NULLIF(mark, '#NULO#') AS mark FROM t",
)
def q_sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("o_orderkey", sentinel_to_null("mark").alias("mark"))


@query(
    "code_decode",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code FROM orders",
)
def q_code_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", code_decode("o_orderstatus", {"F": 0, "O": 1}).alias("code")
    )


@query(
    "list_item_count",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size <= 5 THEN '#NULO#'
                                         ELSE REPLACE(p_name, ' ', ' / ') || ' / ' || p_brand END AS items FROM part)
       SELECT p_partkey, items,
              CAST(CASE WHEN items = '#NULO#' THEN 0 ELSE LEN(STRING_SPLIT(items, ' / ')) END AS INTEGER) AS n_items
       FROM t""",
)
def q_list_item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.when(F.col("p_size") <= 5, "#NULO#").otherwise(
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" / ")), F.lit(" / "), F.col("p_brand"))
    )
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", items.alias("items"))
        .withColumn("n_items", list_item_count("items"))
    )


@query(
    "floor_positive",
    "SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE CAST(0.001 AS DOUBLE) END AS floored, "
    "CASE WHEN NULLIF(s_nationkey, 3) > 0 THEN CAST(NULLIF(s_nationkey, 3) AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS floored_nation "
    "FROM supplier",
)
def q_floor_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn(
        "nation", F.nullif(F.col("s_nationkey"), F.lit(3)).cast("double")
    )
    floored = floor_positive_columns(rows, {"s_acctbal": "floored", "nation": "floored_nation"})
    return floored.select("s_suppkey", "s_acctbal", "floored", "floored_nation")


@query(
    "null_and_equality_flags",
    """SELECT o_orderkey, COALESCE(NULLIF(o_custkey, 7), 0) AS customer_or_zero,
              CASE WHEN NULLIF(o_custkey, 7) IS NOT NULL THEN 1 ELSE 0 END AS has_customer,
              CASE WHEN NULLIF(o_orderstatus, 'F') = 'P' THEN 1 ELSE 0 END AS is_pending,
              CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 1 ELSE 0 END AS is_early
       FROM orders""",
)
def null_and_equality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.nullif(F.col("o_custkey"), F.lit(7))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        null_to(customer, 0).alias("customer_or_zero"),
        present_flag(customer).alias("has_customer"),
        equals_flag(F.nullif(F.col("o_orderstatus"), F.lit("F")), "P").alias("is_pending"),
        before_cutoff_flag("o_orderdate", "1998-01-01 00:00:00").alias("is_early"),
    )


@query(
    "filter_eq",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2",
)
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_equal(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linenumber=2)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "null_audit",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders LEFT JOIN
              (SELECT l_orderkey, MAX(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
       WHERE last_shipped IS NULL ORDER BY o_orderkey LIMIT 100""",
)
def q_null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hundred orders without a shipping time."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_shipped"))
    rows = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return null_audit(rows, "last_shipped", ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey"], limit=100)
