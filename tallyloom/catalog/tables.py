"""Scans, sinks, views, counts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import row_counts, schema_profile, sketch_profile
from ..plans.standin import table
from ..sources import (
    StageStore,
    checked_lines,
    quarantine,
    read_delimited,
    rejects_by_column,
    write_delimited,
    write_parquet,
    write_partitioned,
    write_sorted,
)
from .registry import query

# The given tables: columns with their Spark types.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_COLUMNS = {name: [tuple(c.split(" ")) for c in columns.split(", ")] for name, columns in TABLES.items()}


def _profile_sql() -> str:
    parts = []
    for name, columns in _COLUMNS.items():
        for i, (column, kind) in enumerate(columns):
            sentinels = f"COUNT(*) FILTER (WHERE {column} = '#NULO#')" if kind == "string" else "0"
            parts.append(
                f"SELECT '{name}' AS table_name, {i} AS position, '{column}' AS column_name, "
                f"'{kind}' AS column_type, COUNT(*) AS n_rows, COUNT(*) - COUNT({column}) AS n_nulls, "
                f"CAST({sentinels} AS BIGINT) AS n_sentinels, COUNT(DISTINCT {column}) AS n_distinct FROM {name}"
            )
    return " UNION ALL ".join(parts)


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows FROM {n}" for n in TABLES),
)
def q_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({n: table(spark, sf_dir, n) for n in TABLES})


@query("schema_profile", _profile_sql())
def q_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_profile({n: table(spark, sf_dir, n) for n in TABLES}, distinct="all")


_CODES = ("l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax")


@query(
    "profile_frequent_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n_rows FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"
        for c in _CODES
    ),
)
def q_profile_frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of code columns by the profile's sketch, which is exact while a column has fewer values than counters."""
    profile = sketch_profile(table(spark, sf_dir, "lineitem").select(*_CODES), k=30)
    found = profile.select("column_name", F.explode("frequent").alias("v"))
    return found.select("column_name", F.col("v.item").alias("value"), F.col("v.count").alias("n_rows"))


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")


def _declared(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


@query("scan_csv_roundtrip", "SELECT * FROM customer")
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested globs of Latin-1 text in two layouts, each bound by its own header."""
    store = StageStore(spark)
    rows = table(spark, sf_dir, "customer")
    first = F.col("c_mktsegment") < "F"
    write_delimited(rows.where(first).select(*reversed(rows.columns)), store.path("text/a/1"), encoding="ISO-8859-1")
    others = rows.where(~first).withColumn("c_extra", F.lit("x"))
    write_delimited(others.select("c_extra", *rows.columns), store.path("text/b/1"), encoding="ISO-8859-1")
    layouts = [f"{store.root}/text/a/*/*.csv", f"{store.root}/text/b/*/*.csv"]
    return read_delimited(spark, layouts, _declared("customer"))


@query("scan_csv_file_glob", "SELECT * FROM customer")
def scan_csv_file_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that holds the whole and repeats of it; a name pattern picks the whole."""
    store = StageStore(spark)
    rows = table(spark, sf_dir, "customer")
    write_delimited(rows, store.path("text/WHOLE"), encoding="ISO-8859-1")
    write_delimited(rows.where("c_mktsegment = 'BUILDING'"), store.path("text/PART_1"), encoding="ISO-8859-1")
    return read_delimited(spark, f"{store.root}/text/*WHOLE", _declared("customer"), file_glob="*.csv")


# What a customer's line looks like: in some the third value is in words, others have a field too many, the rest are as declared.
_SPOILT = "c_custkey % 7 = 3"
_LONG = "c_custkey % 11 = 5"
_BALANCE = f"CASE WHEN {_SPOILT} THEN 'about ' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END"


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text with unparsable values and malformed lines, read with a check of every line."""
    store = StageStore(spark)
    fields = f"c_custkey || ';' || c_name || ';' || {_BALANCE.replace('VARCHAR', 'STRING')}"
    line = f"{fields} || CASE WHEN {_LONG} THEN ';extra' ELSE '' END AS `c_custkey;c_name;c_nationkey`"
    # A separator that no text has: lines are written as they are.
    write_delimited(table(spark, sf_dir, "customer").selectExpr(line), store.path("text"), sep="\u0001")
    schema = T.StructType.fromDDL("c_custkey bigint, c_name string, c_nationkey int")
    return checked_lines(spark, store.path("text"), schema, encoding="UTF-8")


@query(
    "scan_quarantine",
    f"""SELECT c_custkey, c_name, c_nationkey, NULL AS raw FROM customer WHERE NOT ({_SPOILT}) AND NOT ({_LONG})
        UNION ALL
        SELECT NULL, NULL, NULL, CASE WHEN {_LONG} THEN c_custkey || ';' || c_name || ';' || {_BALANCE} || ';extra' ELSE {_BALANCE} END
        FROM customer WHERE {_SPOILT} OR {_LONG}""",
)
def scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows, and of bad lines what is wrong: good and bad together are all customers."""
    good, bad = quarantine(StageStore(spark), "customer", _customer_lines(spark, sf_dir))
    return good.withColumn("raw", F.lit(None).cast("string")).unionByName(
        bad.select(F.coalesce("line", F.col("problems")[0]["raw"]).alias("raw")), allowMissingColumns=True
    )


@query(
    "scan_rejects",
    f"""SELECT CASE WHEN {_LONG} THEN NULL ELSE 'c_nationkey' END AS column_name, COUNT(*) AS n_values,
               MIN(CASE WHEN {_LONG} THEN c_custkey || ';' || c_name || ';' || {_BALANCE} || ';extra' ELSE {_BALANCE} END) AS example
        FROM customer WHERE {_SPOILT} OR {_LONG} GROUP BY 1""",
)
def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values did not parse by column, over all files."""
    _, bad = quarantine(StageStore(spark), "customer", _customer_lines(spark, sf_dir))
    found = rejects_by_column(bad).withColumnRenamed("column", "column_name")
    return found.groupBy("column_name").agg(F.sum("n_values").alias("n_values"), F.min("example").alias("example"))


@query(
    "bucketed_stages",
    """SELECT o_orderkey, o_custkey, COUNT(*) AS n_lines, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""",
)
def bucketed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lineitems stored in buckets of the order: joined and folded without a shuffle."""
    store = StageStore(spark)
    orders = store.write_bucketed("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 16)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("bigint").alias("q"))
    joined = orders.join(store.write_bucketed("lineitem", lines, ["o_orderkey"], 16), "o_orderkey")
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("q").alias("quantity"))


@query("sink_csv_roundtrip", "SELECT * FROM supplier")
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore(spark)
    write_delimited(table(spark, sf_dir, "supplier"), store.path("supplier"), encoding="ISO-8859-1")
    return read_delimited(spark, store.path("supplier"), _declared("supplier"), by_name=False)


@query("sink_parquet_roundtrip", "SELECT * FROM orders")
def sink_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore(spark)
    write_parquet(table(spark, sf_dir, "orders"), store.path("orders"))
    return store.read("orders")


@query("sink_sorted_roundtrip", "SELECT * FROM orders")
def sink_sorted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore(spark)
    write_sorted(table(spark, sf_dir, "orders"), store.path("orders"), ["o_orderdate"], partitions=20)
    return store.read("orders")


@query(
    "sink_partitioned_by_group",
    "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderstatus",
)
def sink_partitioned_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore(spark)
    write_partitioned(table(spark, sf_dir, "orders"), store.path("orders"), ["o_orderstatus"])
    return (
        store.read("orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))
    )


@query(
    "sink_partition_pruned",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def sink_partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group's folder of a partitioned export."""
    store = StageStore(spark)
    write_partitioned(table(spark, sf_dir, "orders"), store.path("orders"), ["o_orderstatus"])
    return store.read("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")


_VIEW_SQL = (
    "SELECT r_name, COUNT(*) AS n_nations, MAX(n_name) AS last_nation "
    "FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
)


@query("view_sql_equivalence", _VIEW_SQL)
def view_sql_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over named results; the caller's own views stay as they are."""
    text = _VIEW_SQL.replace("nation JOIN region", "{nation} JOIN {region}")
    return spark.sql(text, nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))
