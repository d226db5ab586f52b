"""Comparison reports, shares, contingency tables and top lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import before_cutoff_flag
from ..operators import (
    compare_by,
    crosstab_long,
    crosstab_wide,
    density_grid,
    having_mixed_groups,
    share_by,
    top_n,
    wide_tally,
)
from ..plans import reports, standin
from ..plans.standin import FLAGS, NAMES, table, votes, with_sections
from ..sources import StageStore
from .registry import query

_A = "CAST(SUM(a_votes) AS BIGINT)"
_R = "CAST(SUM(r_votes) AS BIGINT)"
_SUMS = f"{_A} AS sum_a_votes, {_R} AS sum_r_votes"
_DIFS = f"{_A} - {_R} AS dif_abs, ROUND(SUM(a_votes) / NULLIF(SUM(r_votes), 0) - 1, 2) AS dif_rel"
_REVERSED = f"{_R} - {_A} AS dif_abs, ROUND(SUM(r_votes) / NULLIF(SUM(a_votes), 0) - 1, 2) AS dif_rel"
_STDDEVS = "STDDEV_SAMP(a_votes) AS stddev_a_votes, STDDEV_SAMP(r_votes) AS stddev_r_votes"
_SHARES = (
    "ROUND(SUM(a_votes) / NULLIF(SUM(eligible), 0), 2) AS share_a_votes, "
    "ROUND(SUM(r_votes) / NULLIF(SUM(eligible), 0), 2) AS share_r_votes, "
    "ROUND(SUM(a_votes) / NULLIF(SUM(eligible), 0) - SUM(r_votes) / NULLIF(SUM(eligible), 0), 2) AS dif"
)
_ZONES = f"""SELECT zone_id, MAX(nation) AS nation, MAX(region) AS region, MAX(segment) AS segment, COUNT(*) AS total,
       CAST(SUM(eligible) AS BIGINT) AS sum_eligible,
       CAST(SUM(CASE WHEN model_2020 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_with,
       CAST(SUM(CASE WHEN model_2020 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_without, {_SUMS}, {_DIFS}
FROM sec GROUP BY zone_id
HAVING SUM(eligible) <= (SELECT FLOOR(SUM(eligible) / COUNT(DISTINCT zone_id)) FROM sec) AND SUM(CASE WHEN model_2020 = 1 THEN 1 ELSE 0 END) > 0
       AND SUM(CASE WHEN model_2020 = 0 THEN 1 ELSE 0 END) > 0"""


def _compared(dim: str, where: str = "", extra: str = "", difs: str = _DIFS) -> str:
    name = dim.split(" AS ")[-1]
    group = dim.split(" AS ")[0]
    return with_sections(
        f"SELECT {group} AS {name}, {_SUMS}{extra}, {difs} FROM sec {'WHERE ' + where if where else ''} GROUP BY {group}"
    )


def _opened(cutoff: str) -> str:
    return f"CASE WHEN opened < TIMESTAMP '{cutoff}' THEN 1 ELSE 0 END AS abertura_antes_inicio"


_COMPARISONS = {
    "cmp_01": _compared("prediction"),
    "cmp_02": _compared("model_2020"),
    "cmp_03": _compared("model", "model <> 1"),
    "cmp_04": _compared("late"),
    "cmp_05": _compared("spare"),
    "cmp_06": _compared("a_wins"),
    "cmp_07": _compared("r_wins", difs=_REVERSED),
    "cmp_08": _compared("tie"),
    "cmp_09": _compared("region"),
    "cmp_10": _compared("nation"),
    "cmp_11": with_sections(f"SELECT model_2020, {_SHARES} FROM sec GROUP BY model_2020"),
    "cmp_12": with_sections(f"SELECT model, {_SHARES} FROM sec GROUP BY model"),
    "cmp_13": _compared(_opened("1998-01-01 00:00:00"), "region <> 'MIDDLE EAST'"),
    "cmp_14": with_sections(_ZONES),
    "cmp_15": _compared(
        "model", "nation = 'NATION_3' AND segment = 'BUILDING' AND region = 'EUROPE'", ", COUNT(*) AS total_secoes"
    ),
    "cmp_16": _compared(_opened("1995-06-01 00:00:00"), "region <> 'MIDDLE EAST'"),
    "cmp_17": _compared("model", "model <> 1 AND prediction IN (0, 1, 2)"),
    "cmp_18": _compared("model", "model <> 1 AND prediction = 3"),
    "cmp_19": _compared("model_2020", "model <> 1 AND prediction <> 3"),
    "cmp_20": _compared("model_2020", "model <> 1 AND prediction = 3"),
    "cmp_21": _compared("model_2020", "model <> 1", f", {_STDDEVS}"),
    "cmp_22": with_sections(
        f"SELECT prediction, {_SUMS}, {_A} - {_R} AS dif FROM sec WHERE prediction = 0 GROUP BY prediction"
    ),
    "cmp_23": with_sections(f"SELECT model_2020, {_SUMS}, {_A} + {_R} AS total FROM sec GROUP BY model_2020"),
}


def _mean_size(sec: DataFrame, group: str) -> int:
    """A limit that leaves groups at every scale: the mean number of eligible voters per group."""
    mean = F.floor(F.sum("eligible") / F.count_distinct(group))
    return int(sec.agg(mean.alias("mean")).first()["mean"] or 0)


def _comparison(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sec = standin.sections(spark, sf_dir)
        names = replace(NAMES, zone_limit=_mean_size(sec, "zone_id")) if name == "cmp_14" else NAMES
        return reports.comparisons(sec, sec, names)[name]()

    return run


for _name, _sql in _COMPARISONS.items():
    query(_name, _sql)(_comparison(_name))


# The values that become columns, stated so that the tables are lazy plans.
_VALUES = {
    "prediction": [0, 1, 2, 3, 4],
    "model_2020": [0, 1],
    "model": [1, 2009, 2010, 2011, 2013, 2015, 2020],
    "a_wins": [0, 1],
    "r_wins": [0, 1],
}


def _crossed(rows: str, columns: str) -> str:
    cells = ", ".join(
        f"CAST(SUM(CASE WHEN {columns} = {v} THEN 1 ELSE 0 END) AS BIGINT) AS {columns}_{v}" for v in _VALUES[columns]
    )
    stated = ", ".join(map(str, _VALUES[columns]))
    other = f"CAST(SUM(CASE WHEN {columns} IN ({stated}) THEN 0 ELSE 1 END) AS BIGINT) AS {columns}_other"
    return with_sections(f"SELECT {rows}, {cells}, {other} FROM sec GROUP BY {rows}")


def _crosstab(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.crosstabs(standin.sections(spark, sf_dir), NAMES, _VALUES)[name]()

    return run


for _name, (_rows, _columns, _) in reports.crosstab_pairs(NAMES).items():
    query(_name, _crossed(_rows, _columns))(_crosstab(_name))


_BY_SEGMENT = """WITH tally AS (
  SELECT l_orderkey, CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS a_votes,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS r_votes
  FROM lineitem GROUP BY l_orderkey),
sec AS (SELECT tally.*, o_orderstatus, o_orderpriority, o_orderdate, c_mktsegment
        FROM tally JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
"""


def by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: lineitems folded per order, joined to orders and customers."""
    tally = wide_tally(votes(spark, sf_dir), ["order_id"], "flag", "votes", {k: FLAGS[k] for k in ("A", "R")})
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return tally.join(orders, F.col("order_id") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )


def _query_by_segment(name: str, select: str, tail: str):
    return query(name, f"{_BY_SEGMENT} SELECT {select} FROM sec {tail}")


@_query_by_segment("compare_by_dim", f"c_mktsegment, {_SUMS}, {_DIFS}", "GROUP BY c_mktsegment")
def compare_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_by(by_segment(spark, sf_dir), "c_mktsegment", "a_votes", "r_votes")


@_query_by_segment("compare_by_reversed", f"c_mktsegment, {_SUMS}, {_REVERSED}", "GROUP BY c_mktsegment")
def compare_by_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_by(by_segment(spark, sf_dir), "c_mktsegment", "a_votes", "r_votes", reverse=True)


@_query_by_segment(
    "compare_by_two_dims",
    f"c_mktsegment, o_orderstatus, {_SUMS}, {_DIFS}",
    "GROUP BY c_mktsegment, o_orderstatus",
)
def compare_by_two_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_by(by_segment(spark, sf_dir), ["c_mktsegment", "o_orderstatus"], "a_votes", "r_votes")


@_query_by_segment(
    "compare_filtered",
    f"o_orderpriority, {_SUMS}, {_DIFS}",
    "WHERE c_mktsegment <> 'BUILDING' AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') GROUP BY o_orderpriority",
)
def compare_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (
        (F.col("c_mktsegment") != "BUILDING")
        & F.col("o_orderstatus").isin("F", "O")
        & ~F.col("o_orderpriority").isin("5-LOW")
    )
    return compare_by(by_segment(spark, sf_dir), "o_orderpriority", "a_votes", "r_votes", where=where)


@_query_by_segment(
    "compare_at_point",
    f"o_orderpriority, {_SUMS}, COUNT(*) AS n_orders, {_DIFS}",
    "WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'P' GROUP BY o_orderpriority",
)
def compare_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderstatus") == "P")
    return compare_by(by_segment(spark, sf_dir), "o_orderpriority", "a_votes", "r_votes", where=where, count="n_orders")


@_query_by_segment(
    "compare_before_cutoff",
    f"CASE WHEN o_orderdate < TIMESTAMP '1998-06-30 00:00:00' THEN 1 ELSE 0 END AS early, {_SUMS}, {_DIFS}",
    "GROUP BY 1",
)
def compare_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"early": before_cutoff_flag("o_orderdate", "1998-06-30 00:00:00")}
    return compare_by(by_segment(spark, sf_dir), dims, "a_votes", "r_votes")


@_query_by_segment(
    "compare_with_stddev", f"c_mktsegment, {_SUMS}, {_STDDEVS}, {_DIFS}", "GROUP BY c_mktsegment"
)
def compare_with_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_by(by_segment(spark, sf_dir), "c_mktsegment", "a_votes", "r_votes", stddev=True)


@query("share_by", with_sections(f"SELECT segment, {_SHARES} FROM sec WHERE spare = 0 GROUP BY segment"))
def q_share_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = standin.sections(spark, sf_dir)
    return share_by(sec, "segment", "a_votes", "r_votes", "eligible", where=F.col("spare") == 0)


@query(
    "having_mixed_groups",
    with_sections(
        f"""SELECT nation, MAX(region) AS region, COUNT(*) AS total, CAST(SUM(eligible) AS BIGINT) AS sum_eligible,
                   CAST(SUM(CASE WHEN late = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_late,
                   CAST(SUM(CASE WHEN late = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_time, {_SUMS}, {_DIFS}
            FROM sec GROUP BY nation
            HAVING SUM(eligible) <= (SELECT FLOOR(SUM(eligible) / COUNT(DISTINCT nation)) FROM sec) AND SUM(CASE WHEN late = 1 THEN 1 ELSE 0 END) > 0
                   AND SUM(CASE WHEN late = 0 THEN 1 ELSE 0 END) > 0"""
    ),
)
def q_having_mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = standin.sections(spark, sf_dir)
    return having_mixed_groups(
        sec,
        "nation",
        "a_votes",
        "r_votes",
        labels=["region"],
        size="eligible",
        max_size=_mean_size(sec, "nation"),
        flag="late",
        with_name="n_late",
        without_name="n_in_time",
    )


@query(
    "crosstab_long",
    "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus",
)
def q_crosstab_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab_long(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "crosstab_wide",
    """WITH t AS (SELECT NULLIF(c_mktsegment, 'BUILDING') AS segment, NULLIF(o_orderstatus, 'O') AS status
                 FROM orders JOIN customer ON c_custkey = o_custkey)
       SELECT segment, CAST(SUM(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS status_F,
              CAST(SUM(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS status_P,
              CAST(SUM(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS status_null,
              CAST(SUM(CASE WHEN status NOT IN ('F', 'P') THEN 1 ELSE 0 END) AS BIGINT) AS status_other FROM t GROUP BY segment""",
)
def q_crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL rows and columns have their own cells, and any other value the last one."""
    customer = table(spark, sf_dir, "customer")
    rows = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
            F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"),
        )
    )
    return crosstab_wide(rows, "segment", "status", ["F", "P", None])


@query(
    "crosstab_ordered",
    """SELECT l_linenumber, CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS flag_A,
              CAST(SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag_N,
              CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS flag_R,
              CAST(SUM(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 0 ELSE 1 END) AS BIGINT) AS flag_other
       FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber""",
)
def q_crosstab_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return crosstab_wide(lines, "l_linenumber", "l_returnflag", ["A", "N", "R"], prefix="flag_", ordered=True)


_TOP = "order_id, nation, region, segment, a_votes, r_votes, n_votes, eligible, a_share"


@query(
    "top_n_filtered",
    with_sections(
        f"""SELECT {_TOP} FROM sec WHERE a_share BETWEEN 0.0 AND 1.0 AND prediction <> 3 AND model_2020 = 0
            ORDER BY a_share DESC, order_id LIMIT 100000"""
    ),
)
def top_n_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a stored section table: the values are read once for the bins and once for the rows."""
    sec = StageStore(spark).write("sections", standin.sections(spark, sf_dir))
    return reports.top_shares(sec, _TOP.split(", "), NAMES)


@query(
    "top_n_density",
    with_sections(
        """, best AS (SELECT region, a_votes, r_votes FROM sec WHERE a_share BETWEEN 0.0 AND 1.0 AND prediction <> 3
                      AND model_2020 = 0 ORDER BY a_share DESC, order_id LIMIT 100000)
           SELECT region, CAST(FLOOR(a_votes / CAST(10 AS DOUBLE)) AS BIGINT) AS cell_x,
                  CAST(FLOOR(r_votes / CAST(10 AS DOUBLE)) AS BIGINT) AS cell_y, COUNT(*) AS n
           FROM best GROUP BY ALL"""
    ),
)
def top_n_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scatter of both counts over the top list."""
    sec = StageStore(spark).write("sections", standin.sections(spark, sf_dir))
    best = reports.top_shares(sec, ["region", "a_votes", "r_votes"], NAMES)
    return density_grid(best, "a_votes", "r_votes", 10.0, 10.0, "region")


@query(
    "top_n_small",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_n_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return top_n(orders, "o_totalprice", 25, ["o_orderkey"], F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query(
    "top_n_unbounded",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice LIMIT 20000""",
)
def top_n_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long top list of a measure with few values, by a cut-off that a sketch proposes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return top_n(lines, "l_quantity", 20_000, ["l_orderkey", "l_linenumber", "l_extendedprice"])
