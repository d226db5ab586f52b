"""A section table derived from the star-schema tables.

An order plays the section, its lineitems the bulletin rows, the return flag the
votable, quantity the votes, and customer, nation and region the section's
surroundings. Suppliers play the poll workers of a zone (a nation).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import LateRule, composite_key, elapsed_seconds, equals_flag, late_expr, range_bucket
from ..operators import conditional_sum_by_key, left_join_default, tally_ratios, wide_tally, winner_flags
from .reports import Names

FLAGS = {"A": "a_votes", "R": "r_votes", "N": "n_votes"}

MODEL_RANGES = ((0, 199, 2009), (200, 449, 2010), (500, 699, 2011), (700, 899, 2013), (1000, 1249, 2015), (1250, 100000, 2020))

LATE_RULES = (
    LateRule("2001-03-31 00:00:00", {"region": ("AFRICA", "AMERICA")}),
    LateRule("2000-06-30 00:00:00", {"region": ("ASIA", "EUROPE")}, {"nation_id": (7, 8, 13)}),
    LateRule("1999-12-31 00:00:00", {"region": ("MIDDLE EAST",), "nation_id": (7, 8, 13)}),
)

NAMES = replace(
    Names(),
    a="a_votes",
    b="r_votes",
    share_a="a_share",
    share_b="r_share",
    eligible="eligible",
    group="prediction",
    model="model",
    new_model="model_2020",
    late="late",
    spare="spare",
    a_wins="a_wins",
    b_wins="r_wins",
    tie="tie",
    region="region",
    state="nation",
    zone="zone_id",
    has_workers="zone_has_workers",
    opened="opened",
    key="order_id",
    zone_labels=("nation", "region", "segment"),
    point=(("nation", "NATION_3"), ("segment", "BUILDING"), ("region", "EUROPE")),
    no_model=1,
    abroad="MIDDLE EAST",
    opening="1998-01-01 00:00:00",
    early_opening="1995-06-01 00:00:00",
    others=(0, 1, 2),
    last_group=3,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as bulletin rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").cast("bigint").alias("votes"),
        F.col("l_shipdate").alias("shipped"),
    )


def surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, nation and region: the attributes of a section."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            composite_key("c_nationkey", "c_mktsegment").alias("zone_id"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderdate").alias("opened"),
            F.floor(F.col("o_totalprice") / F.lit(1000.0)).alias("eligible"),
            range_bucket("o_custkey", MODEL_RANGES, 1).alias("model"),
            equals_flag("o_orderstatus", "P").alias("spare"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("prediction"),
        )
    )


def zone_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a high balance per nation, in two kinds; some nations have none."""
    return conditional_sum_by_key(
        table(spark, sf_dir, "supplier"),
        {"nation_id": F.col("s_nationkey")},
        F.lit(1).cast("bigint"),
        {"volunteers": F.col("s_acctbal") >= 9000, "non_volunteers": F.col("s_acctbal") < 9000},
        where=F.col("s_acctbal") >= 6500,
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide section table: lineitems folded first, then joined one row to one row."""
    tally = wide_tally(
        votes(spark, sf_dir), ["order_id"], "flag", "votes", FLAGS, latest={"last_shipped": "shipped"}
    )
    wide = tally.join(surroundings(spark, sf_dir), "order_id")
    wide = winner_flags(wide, "a_votes", "r_votes", "a_wins", "r_wins", "tie")
    wide = tally_ratios(
        wide,
        {"a_share": ("a_votes", "eligible"), "r_share": ("r_votes", "eligible"), "n_share": ("n_votes", "eligible")},
    )
    wide = wide.withColumns(
        {
            "model_2020": equals_flag("model", 2020),
            "late": late_expr("last_shipped", LATE_RULES),
            "seconds_open": elapsed_seconds("last_shipped", "opened"),
        }
    )
    return left_join_default(
        wide,
        zone_workers(spark, sf_dir),
        ["nation_id"],
        {"volunteers": 0, "non_volunteers": 0},
        {"zone_has_workers": "volunteers"},
    )


# The same table in SQL, as the head of the SQL checks.
SECTIONS_SQL = """
tally AS (
  SELECT l_orderkey AS order_id,
         CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS a_votes,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS r_votes,
         CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS n_votes,
         MAX(l_shipdate) AS last_shipped
  FROM lineitem GROUP BY l_orderkey),
workers AS (
  SELECT s_nationkey AS nation_id,
         CAST(SUM(CASE WHEN s_acctbal >= 9000 THEN 1 ELSE 0 END) AS BIGINT) AS volunteers,
         CAST(SUM(CASE WHEN s_acctbal < 9000 THEN 1 ELSE 0 END) AS BIGINT) AS non_volunteers
  FROM supplier WHERE s_acctbal >= 6500 GROUP BY s_nationkey),
wide AS (
  SELECT o_orderkey AS order_id,
         CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS zone_id,
         c_nationkey AS nation_id, n_name AS nation, r_name AS region, c_mktsegment AS segment,
         o_orderdate AS opened, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS eligible,
         CASE WHEN o_custkey BETWEEN 0 AND 199 THEN 2009 WHEN o_custkey BETWEEN 200 AND 449 THEN 2010
              WHEN o_custkey BETWEEN 500 AND 699 THEN 2011 WHEN o_custkey BETWEEN 700 AND 899 THEN 2013
              WHEN o_custkey BETWEEN 1000 AND 1249 THEN 2015 WHEN o_custkey BETWEEN 1250 AND 100000 THEN 2020
              ELSE 1 END AS model,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS spare,
         CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) - 1 AS prediction
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sec AS (
  SELECT wide.*, a_votes, r_votes, n_votes, last_shipped,
         CASE WHEN a_votes > r_votes THEN 1 ELSE 0 END AS a_wins,
         CASE WHEN a_votes < r_votes THEN 1 ELSE 0 END AS r_wins,
         CASE WHEN a_votes = r_votes THEN 1 ELSE 0 END AS tie,
         a_votes / NULLIF(eligible, 0) AS a_share,
         r_votes / NULLIF(eligible, 0) AS r_share,
         n_votes / NULLIF(eligible, 0) AS n_share,
         CASE WHEN model = 2020 THEN 1 ELSE 0 END AS model_2020,
         CASE WHEN (last_shipped > TIMESTAMP '2001-03-31 00:00:00' AND region IN ('AFRICA', 'AMERICA'))
                OR (last_shipped > TIMESTAMP '2000-06-30 00:00:00' AND region IN ('ASIA', 'EUROPE')
                    AND wide.nation_id NOT IN (7, 8, 13))
                OR (last_shipped > TIMESTAMP '1999-12-31 00:00:00'
                    AND (region = 'MIDDLE EAST' OR wide.nation_id IN (7, 8, 13))) THEN 1 ELSE 0 END AS late,
         CAST(EPOCH(last_shipped) AS BIGINT) - CAST(EPOCH(opened) AS BIGINT) AS seconds_open,
         COALESCE(volunteers, 0) AS volunteers, COALESCE(non_volunteers, 0) AS non_volunteers,
         CASE WHEN volunteers IS NOT NULL THEN 1 ELSE 0 END AS zone_has_workers
  FROM tally JOIN wide USING (order_id) LEFT JOIN workers ON wide.nation_id = workers.nation_id)
"""


def with_sections(sql: str) -> str:
    return f"WITH {SECTIONS_SQL} {sql}"
