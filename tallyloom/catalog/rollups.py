"""Reports that are answered from one fold of the section table."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, whole_as_long
from ..plans import reports, standin
from ..plans.standin import NAMES, with_sections
from ..sources import StageStore
from .registry import query
from .reports import _COMPARISONS, _VALUES, _mean_size

_DIMS = {
    "cmp_13": "abertura_antes_inicio",
    "cmp_14": "zone_id",
    "cmp_16": "abertura_antes_inicio",
    **dict.fromkeys(("cmp_01", "cmp_22"), "prediction"),
    **dict.fromkeys(("cmp_02", "cmp_11", "cmp_19", "cmp_20", "cmp_21", "cmp_23"), "model_2020"),
    **dict.fromkeys(("cmp_03", "cmp_12", "cmp_15", "cmp_17", "cmp_18"), "model"),
    "cmp_04": "late",
    "cmp_05": "spare",
    "cmp_06": "a_wins",
    "cmp_07": "r_wins",
    "cmp_08": "tie",
    "cmp_09": "region",
    "cmp_10": "nation",
}


def _body(sql: str) -> str:
    """The report's own SELECT, without the section table before it."""
    return sql.removeprefix(with_sections(""))


def _long_sql() -> str:
    """Report, group and the two sums of every comparison; shares and gaps where a report has no sums."""
    parts = []
    for name, dim in _DIMS.items():
        x, y = ("share_a_votes", "share_r_votes") if name in ("cmp_11", "cmp_12") else ("sum_a_votes", "sum_r_votes")
        last = {"cmp_11": "dif", "cmp_12": "dif", "cmp_22": "dif", "cmp_23": "total", "cmp_21": "stddev_a_votes"}.get(name, "dif_rel")
        parts.append(
            f"SELECT '{name}' AS report, CAST({dim} AS VARCHAR) AS grp, CAST({x} AS DOUBLE) AS first, "
            f"CAST({y} AS DOUBLE) AS second, CAST({last} AS DOUBLE) AS last FROM ({_body(_COMPARISONS[name])})"
        )
    return with_sections(" UNION ALL ".join(parts))


@query("folded_comparisons", _long_sql())
def folded_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 comparisons from one reading of the sections, in long form."""
    sec = StageStore(spark).write("sections", standin.sections(spark, sf_dir))
    names = replace(NAMES, zone_limit=_mean_size(sec, "zone_id"))
    made = reports.fold_reports(sec, sec, StageStore(spark), names).comparisons()
    parts = []
    for name, dim in _DIMS.items():
        df = made[name]()
        last = next(c for c in ("stddev_a_votes", "dif_rel", "total", "dif") if c in df.columns and (name, c) != ("cmp_14", "total"))
        x, y = (c for c in df.columns if c in ("sum_a_votes", "sum_r_votes", "share_a_votes", "share_r_votes"))
        values = {"first": x, "second": y, "last": last}
        parts.append(
            df.select(
                F.lit(name).alias("report"),
                F.col(dim).cast("string").alias("grp"),
                *(F.col(c).cast("double").alias(n) for n, c in values.items()),
            )
        )
    return reduce(DataFrame.unionAll, parts)


def _pairs_sql() -> str:
    return with_sections(
        " UNION ALL ".join(
            f"SELECT '{name}' AS report, CAST({rows} AS VARCHAR) AS row_value, CAST({columns} AS VARCHAR) AS column_value, "
            f"COUNT(*) AS n FROM sec GROUP BY {rows}, {columns}"
            for name, (rows, columns, _) in reports.crosstab_pairs(NAMES).items()
        )
    )


@query("folded_crosstabs", _pairs_sql())
def folded_crosstabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 12 contingency tables from one reading of the sections, in long form."""
    sec = StageStore(spark).write("sections", standin.sections(spark, sf_dir))
    made = reports.fold_reports(sec, sec, StageStore(spark), NAMES).crosstabs(_VALUES, wide=False)
    parts = [
        made[name]().select(
            F.lit(name).alias("report"),
            F.col(rows).cast("string").alias("row_value"),
            F.col(columns).cast("string").alias("column_value"),
            "n",
        )
        for name, (rows, columns, _) in reports.crosstab_pairs(NAMES).items()
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    "fold_cells",
    """SELECT CASE WHEN GROUPING(l_returnflag) = 0 AND GROUPING(l_shipmode) = 0 THEN 0 WHEN GROUPING(l_shipmode) = 0 THEN 1 ELSE 2 END AS cell_set,
              l_returnflag, l_shipmode, COUNT(*) AS cell_rows, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber,
              CAST(SUM(l_orderkey) AS BIGINT) AS sum_l_orderkey, COUNT(l_orderkey) AS count_l_orderkey, CAST(SUM(l_orderkey) AS BIGINT) AS total_l_orderkey,
              CAST(SUM(CAST(l_orderkey AS HUGEINT) * l_orderkey) AS BIGINT) AS square_l_orderkey, MAX(l_suppkey) AS max_l_suppkey
       FROM (SELECT * REPLACE (NULLIF(l_returnflag, 'A') AS l_returnflag) FROM
             (SELECT *, CAST(l_suppkey % 7 AS BIGINT) AS l_shipmode FROM lineitem))
       GROUP BY GROUPING SETS ((l_returnflag, l_shipmode), (l_shipmode), ())""",
)
def fold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets of cells from one reading; NULL is a value of a dim."""
    lines = standin.table(spark, sf_dir, "lineitem")
    dims = {"l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("A")), "l_shipmode": (F.col("l_suppkey") % 7).cast("long")}
    sets = [["l_returnflag", "l_shipmode"], ["l_shipmode"], []]
    cells = fold(lines, dims, sets, sums=["l_linenumber"], squares=["l_orderkey"], maxima=["l_suppkey"])
    # The cells are few, and their types depend on them, so they are stored before.
    cells = StageStore(spark).write("cells", cells)
    return whole_as_long(cells, ["total_l_orderkey", "square_l_orderkey"])


