"""Folds of detail to wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import LateRule, composite_key, elapsed_seconds, equals_flag
from ..operators import (
    conditional_sum_by_key,
    distinct_list,
    late_flag,
    late_flag_from_table,
    sum_by_category,
    sum_pair_by_group,
    tally_ratios,
    wide_tally,
    winner_flags,
)
from ..plans import standin
from ..plans.standin import FLAGS, table, votes, with_sections
from .registry import query

_TALLY = "SELECT order_id, a_votes, r_votes, n_votes"


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_tally(votes(spark, sf_dir), ["order_id"], "flag", "votes", FLAGS)


@query(
    "wide_tally",
    """WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linestatus) AS rn
                 FROM lineitem)
       SELECT l_orderkey,
              MAX(CASE WHEN rn = 1 THEN l_suppkey END) AS supplier, MAX(CASE WHEN rn = 1 THEN l_partkey END) AS part,
              MAX(CASE WHEN rn = 1 THEN l_linestatus END) AS status,
              CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS a_votes,
              CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS r_votes,
              CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS n_votes,
              MAX(l_shipdate) AS last_shipped, COUNT(*) AS n_lines
       FROM l GROUP BY l_orderkey""",
)
def q_wide_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants that do vary here: all of them come from the smallest row."""
    return wide_tally(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        "l_returnflag",
        F.col("l_quantity").cast("bigint"),
        FLAGS,
        constants={"supplier": "l_suppkey", "part": "l_partkey", "status": "l_linestatus"},
        latest={"last_shipped": "l_shipdate"},
        extra=[F.count(F.lit(1)).alias("n_lines")],
    )


@query(
    "wide_tally_column_pick",
    """SELECT l_orderkey, MIN(l_suppkey) AS supplier, MIN(l_partkey) AS part,
              CASE WHEN MIN(l_linenumber) = 1 THEN 1 ELSE 0 END AS starts_at_one,
              CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS a_votes,
              CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS r_votes,
              CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS n_votes
       FROM lineitem GROUP BY l_orderkey""",
)
def wide_tally_column_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_tally(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        "l_returnflag",
        F.col("l_quantity").cast("bigint"),
        FLAGS,
        constants={"supplier": "l_suppkey", "part": "l_partkey", "line": "l_linenumber"},
        pick="column",
    )
    return wide.withColumn("starts_at_one", equals_flag("line", 1)).drop("line")


@query("winner_flags", with_sections(_TALLY + ", a_wins, r_wins, tie FROM sec"))
def q_winner_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winner_flags(_tally(spark, sf_dir), "a_votes", "r_votes", "a_wins", "r_wins", "tie")


@query(
    "tally_ratios",
    with_sections(
        """SELECT order_id, a_votes / NULLIF(r_votes, 0) AS a_per_r, n_votes / NULLIF(a_votes + r_votes + n_votes, 0) AS n_part
           FROM tally"""
    ),
)
def q_tally_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tally(spark, sf_dir).withColumn("total", F.col("a_votes") + F.col("r_votes") + F.col("n_votes"))
    ratios = tally_ratios(rows, {"a_per_r": ("a_votes", "r_votes"), "n_part": ("n_votes", "total")})
    return ratios.select("order_id", "a_per_r", "n_part")


@query(
    "late_flag",
    """SELECT user_id, MAX(CASE WHEN (ts > TIMESTAMP '2024-01-29 12:00:00' AND event_type IN ('view', 'click'))
                            OR (ts > TIMESTAMP '2024-01-28 00:00:00' AND event_type IN ('purchase', 'signup') AND user_id NOT IN (3, 5, 8, 13))
                            OR (ts > TIMESTAMP '2024-01-24 06:00:00' AND (event_type = 'error' OR user_id IN (3, 5, 8, 13)))
                            THEN 1 ELSE 0 END) AS late
       FROM events GROUP BY user_id""",
)
def q_late_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = {"user_id": (3, 5, 8, 13)}
    rules = [
        LateRule("2024-01-29 12:00:00", {"event_type": ("view", "click")}),
        LateRule("2024-01-28 00:00:00", {"event_type": ("purchase", "signup")}, listed),
        LateRule("2024-01-24 06:00:00", {"event_type": ("error",), **listed}),
    ]
    return late_flag(table(spark, sf_dir, "events"), ["user_id"], "ts", rules)


@query(
    "late_flag_from_table",
    """WITH cut AS (SELECT r_regionkey AS area, CASE WHEN r_regionkey < 2 THEN TIMESTAMP '2001-06-30 00:00:00'
                                                 ELSE TIMESTAMP '2000-12-31 00:00:00' END AS c FROM region WHERE r_regionkey <> 4)
       SELECT l_orderkey, MAX(CASE WHEN l_shipdate > COALESCE(CASE WHEN s_nationkey IN (5, 6) THEN TIMESTAMP '1999-06-30 00:00:00' END, c)
                              THEN 1 ELSE 0 END) AS late
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
            LEFT JOIN cut ON area = n_regionkey GROUP BY l_orderkey""",
)
def q_late_flag_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-offs per region, two nations with their own, and one region without any."""
    region = table(spark, sf_dir, "region").where("r_regionkey <> 4")
    general = region.select(
        F.col("r_regionkey").alias("area"),
        F.lit(None).cast("int").alias("exception"),
        F.when(F.col("r_regionkey") < 2, F.lit("2001-06-30 00:00:00"))
        .otherwise("2000-12-31 00:00:00")
        .cast("timestamp_ntz")
        .alias("cutoff_ts"),
    )
    special = table(spark, sf_dir, "nation").where("n_nationkey IN (5, 6)").select(
        F.col("n_regionkey").alias("area"),
        F.col("n_nationkey").alias("exception"),
        F.lit("1999-06-30 00:00:00").cast("timestamp_ntz").alias("cutoff_ts"),
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    )
    return late_flag_from_table(
        lines, ["l_orderkey"], "l_shipdate", "n_regionkey", general.unionByName(special), "n_nationkey"
    )


@query(
    "distinct_list",
    """SELECT l_orderkey, STRING_AGG(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey""",
)
def q_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(distinct_list("l_returnflag").alias("flags"))


@query(
    "distinct_list_domain",
    """SELECT l_orderkey, STRING_AGG(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines
       FROM lineitem GROUP BY l_orderkey""",
)
def distinct_list_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a closed domain, in one integer of state per key."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(distinct_list("l_linenumber", domain=range(1, 8)).alias("lines"))


@query(
    "elapsed_seconds",
    """SELECT user_id, CAST(EPOCH(DATE_TRUNC('second', MAX(ts))) AS BIGINT) - CAST(EPOCH(DATE_TRUNC('second', MIN(ts))) AS BIGINT) AS forward,
              CAST(EPOCH(DATE_TRUNC('second', MIN(ts))) AS BIGINT) - CAST(EPOCH(DATE_TRUNC('second', MAX(ts))) AS BIGINT) AS backward
       FROM events GROUP BY user_id""",
)
def q_elapsed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select(
        "user_id", elapsed_seconds("b", "a").alias("forward"), elapsed_seconds("a", "b").alias("backward")
    )


@query(
    "sum_by_category",
    "SELECT l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_linestatus",
)
def q_sum_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_by_category(table(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_quantity").cast("bigint"))


@query(
    "conditional_sum_by_key",
    """SELECT CONCAT_WS('-', l_suppkey, l_linenumber) AS zone_id,
              CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS volunteers,
              CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS others
       FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""",
)
def q_conditional_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditional_sum_by_key(
        table(spark, sf_dir, "lineitem"),
        {"zone_id": composite_key("l_suppkey", "l_linenumber")},
        F.col("l_quantity").cast("bigint"),
        {"volunteers": F.col("l_returnflag") == "A", "others": F.col("l_returnflag") == "N"},
        where=F.col("l_linestatus") == "O",
    )


@query(
    "sum_pair_by_group",
    with_sections(
        """SELECT segment, CAST(SUM(a_votes) AS BIGINT) AS sum_a_votes, CAST(SUM(r_votes) AS BIGINT) AS sum_r_votes,
                  CAST(SUM(a_votes) - SUM(r_votes) AS BIGINT) AS dif FROM sec GROUP BY segment"""
    ),
)
def q_sum_pair_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_pair_by_group(standin.sections(spark, sf_dir), "segment", "a_votes", "r_votes")


@query(
    "section_table",
    with_sections(
        """SELECT order_id, zone_id, nation, region, segment, eligible, model, spare, prediction, a_votes, r_votes, n_votes,
                  a_wins, r_wins, tie, a_share, r_share, n_share, model_2020, late, seconds_open, volunteers, non_volunteers,
                  zone_has_workers FROM sec"""
    ),
)
def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole wide table: fold, joins, flags, ratios and zone features."""
    return standin.sections(spark, sf_dir).drop("opened", "last_shipped", "nation_id")
