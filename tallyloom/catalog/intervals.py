"""Numbers looked up in tables of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import interval_join, range_bucket_from_table
from ..plans.standin import table
from .registry import query

# An interval of order keys per customer: overlapping, with gaps, some open, some empty.
_RANGES_SQL = """ranges AS (SELECT c_custkey AS range_id,
    CASE WHEN c_custkey % 97 <> 0 THEN c_custkey * 23 - c_nationkey * 40 END AS low,
    CASE WHEN c_custkey % 89 <> 0 THEN c_custkey * 23 + (c_custkey % 11) * (c_custkey % 11) - 9 END AS high,
    c_mktsegment AS label, (c_custkey * 7919) % 1009 AS rank FROM customer)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("range_id"),
        F.when(key % 97 != 0, key * 23 - nation * 40).alias("low"),
        F.when(key % 89 != 0, key * 23 + (key % 11) * (key % 11) - 9).alias("high"),
        F.col("c_mktsegment").alias("label"),
        ((key * 7919) % 1009).alias("rank"),
    )


@query(
    "range_bucket_from_table",
    f"""WITH {_RANGES_SQL}, best AS (SELECT o_orderkey, MIN({{'r': rank, 'l': label}}) AS b FROM orders JOIN ranges
            ON o_orderkey >= coalesce(low, -9223372036854775808) AND o_orderkey <= coalesce(high, 9223372036854775807) GROUP BY o_orderkey)
        SELECT o_orderkey, o_custkey, coalesce(b.l, 'none') AS bucket FROM orders LEFT JOIN best USING (o_orderkey)""",
)
def q_range_bucket_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of a machine by a table of number ranges: here a segment by order key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return range_bucket_from_table(orders, "o_orderkey", _ranges(spark, sf_dir), "low", "high", "label", "rank", "bucket", "none")


@query(
    "interval_join_counts",
    f"""WITH {_RANGES_SQL} SELECT range_id, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS sum_keys FROM orders JOIN ranges
            ON o_orderkey >= coalesce(low, -9223372036854775808) AND o_orderkey <= coalesce(high, 9223372036854775807) GROUP BY range_id""",
)
def q_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    matches = interval_join(orders, "o_orderkey", _ranges(spark, sf_dir), "low", "high", "n", {"sum_keys": "o_orderkey"})
    return matches.groupBy("range_id").agg(F.sum("n").alias("n"), F.sum("sum_keys").alias("sum_keys"))
