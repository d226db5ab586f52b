"""Samples and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    bernoulli_sample,
    contours,
    density_grid,
    density_levels,
    hash_sample,
    kernel_density,
    marginal_histogram,
    mass_lines,
    sample_projection,
)
from ..plans import reports, standin
from ..plans.standin import NAMES, table, with_sections
from ..sources import StageStore
from .registry import query

# One tenth of the 32-bit range, as the first eight digits of the digest.
_TENTH = "'19999999'"


@query(
    "hash_sample",
    f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        WHERE SUBSTR(MD5(CONCAT_WS('-', l_orderkey, l_linenumber, '42')), 1, 8) < {_TENTH}""",
)
def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return hash_sample(lines, ["l_orderkey", "l_linenumber"], 0.1, 42)


@query("hash_sample_whole", "SELECT o_orderkey, o_orderstatus FROM orders")
def hash_sample_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 1.0)


@query("bernoulli_sample", "SELECT COUNT(*) AS n_orders, 1 AS within_five_sigma, CAST(0 AS BIGINT) AS n_strangers FROM orders")
def q_bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any sample: its rows are orders, each once at most, and about a tenth of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    drawn = bernoulli_sample(orders, 0.1).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("drawn"))
    both = orders.withColumn("known", F.lit(1)).join(drawn, "o_orderkey", "full")
    n, k = F.count("known"), F.sum(F.coalesce("drawn", F.lit(0)))
    near = F.abs(k - 0.1 * n) <= 5 * F.sqrt(0.1 * 0.9 * n)
    strangers = F.count(F.when(F.col("known").isNull() | (F.col("drawn") > 1), 1))
    return both.agg(n.alias("n_orders"), near.cast("int").alias("within_five_sigma"), strangers.alias("n_strangers"))


@query(
    "sample_projection",
    with_sections(
        f"""SELECT a_share, r_share, region FROM sec
            WHERE prediction = 1 AND SUBSTR(MD5(CONCAT_WS('-', order_id, '42')), 1, 8) < {_TENTH}"""
    ),
)
def q_sample_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_projection(
        standin.sections(spark, sf_dir),
        ["a_share", "r_share", "region"],
        ["order_id"],
        F.col("prediction") == 1,
        0.1,
    )


_GRID = """grid AS (
  SELECT region, CAST(FLOOR(a_share / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_x,
         CAST(FLOOR(r_share / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_y, COUNT(*) AS n
  FROM sec WHERE a_share IS NOT NULL AND r_share IS NOT NULL GROUP BY 1, 2, 3)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_grid(standin.sections(spark, sf_dir), "a_share", "r_share", 0.05, 0.05, "region")


def _leveled(grid: str, hue: str) -> str:
    return with_sections(
        f""", {grid},
        run AS (SELECT {hue}, n, SUM(n) OVER (PARTITION BY {hue} ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
                       SUM(n) OVER (PARTITION BY {hue}) AS total FROM grid),
        lines AS (SELECT {hue}, MAX(CASE WHEN running >= (CAST(1 AS DOUBLE) - CAST(0.05 AS DOUBLE)) * total THEN n END) AS l0,
                         MAX(CASE WHEN running >= (CAST(1 AS DOUBLE) - CAST(0.525 AS DOUBLE)) * total THEN n END) AS l1,
                         MAX(n) AS l2 FROM run GROUP BY {hue})
        SELECT grid.*, CASE WHEN n >= l0 THEN 1 ELSE 0 END + CASE WHEN n >= l1 THEN 1 ELSE 0 END
                       + CASE WHEN n >= l2 THEN 1 ELSE 0 END AS level
        FROM grid JOIN lines USING ({hue})"""
    )


@query("density_grid", with_sections(f", {_GRID} SELECT * FROM grid"))
def q_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query("density_levels", _leveled(_GRID, "region"))
def q_density_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_levels(_grid(spark, sf_dir), "region", levels=3)


@query(
    "marginal_histogram",
    with_sections(
        """SELECT model, CAST(FLOOR(n_share / CAST(0.02 AS DOUBLE)) AS BIGINT) AS bucket, COUNT(*) AS n
           FROM sec WHERE n_share IS NOT NULL GROUP BY 1, 2"""
    ),
)
def q_marginal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginal_histogram(standin.sections(spark, sf_dir), "n_share", 0.02, "model")


def _plot(variant: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = reports.distributions(standin.sections(spark, sf_dir), NAMES, variant, width=0.05)
        return made[name]()["cells"]

    return run


def _plot_where(variant: str, group: int | None, hue: str, fraction: float) -> list[str]:
    conditions = []
    if group is not None:
        conditions.append(f"prediction = {group}")
    if (variant, group, hue) == ("C", 1, "model"):
        conditions.append("model <> 1")
    if fraction < 1:
        conditions.append(f"SUBSTR(MD5(CONCAT_WS('-', order_id, '42')), 1, 8) < {_TENTH}")
    return conditions


def _plot_sql(variant: str, group: int | None, hue: str, fraction: float) -> str:
    conditions = ["a_share IS NOT NULL", "r_share IS NOT NULL", *_plot_where(variant, group, hue, fraction)]
    grid = f"""grid AS (
      SELECT {hue}, CAST(FLOOR(a_share / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_x,
             CAST(FLOOR(r_share / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cell_y, COUNT(*) AS n
      FROM sec WHERE {' AND '.join(conditions)} GROUP BY 1, 2, 3)"""
    return _leveled(grid, hue)


def _marginals(variant: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Both marginals of every plot of a variant, over a stored section table."""
        sec = StageStore(spark).write("sections", standin.sections(spark, sf_dir))
        parts = []
        for name, layers in reports.distributions(sec, NAMES, variant, width=0.05).items():
            made = layers()
            for axis in ("x", "y"):
                rows = made[f"marginal_{axis}"]
                hue = next(c for c in rows.columns if c not in ("bucket", "n"))
                parts.append(
                    rows.select(
                        F.lit(name).alias("plot"), F.lit(axis).alias("axis"), F.col(hue).cast("string").alias("hue"), "bucket", "n"
                    )
                )
        return reduce(DataFrame.unionByName, parts)

    return run


def _marginals_sql(variant: str) -> str:
    parts = []
    for group, hue, fraction in reports.distribution_specs(NAMES)[variant]:
        for axis, share in (("x", "a_share"), ("y", "r_share")):
            conditions = [f"{share} IS NOT NULL", *_plot_where(variant, group, hue, fraction)]
            parts.append(
                f"""SELECT '{reports.distribution_name(group, hue)}' AS plot, '{axis}' AS axis, CAST({hue} AS VARCHAR) AS hue,
                    CAST(FLOOR({share} / CAST(0.05 AS DOUBLE)) AS BIGINT) AS bucket, COUNT(*) AS n
                    FROM sec WHERE {' AND '.join(conditions)} GROUP BY ALL"""
            )
    return with_sections(" UNION ALL ".join(parts))


for _variant, _specs in reports.distribution_specs(NAMES).items():
    _prefix = "plot" if _variant == "C" else f"plot_{_variant.lower()}"
    for _group, _hue, _fraction in _specs:
        _name = reports.distribution_name(_group, _hue)
        query(f"{_prefix}_{_name}", _plot_sql(_variant, _group, _hue, _fraction))(_plot(_variant, _name))
    query(f"marginals_{_variant.lower()}", _marginals_sql(_variant))(_marginals(_variant))


def _kernel_sql(width: float) -> str:
    half, step = f"CAST({width / 2} AS DOUBLE)", f"CAST({width} AS DOUBLE)"

    def scott(c: str) -> str:
        return f"CASE WHEN COUNT(*) > 1 THEN greatest(STDDEV_SAMP({c}) * pow(COUNT(*), CAST(-1 AS DOUBLE) / 6), {half}) ELSE {half} END"

    return f""", pts AS (SELECT region, a_share AS x, r_share AS y FROM sec WHERE a_share IS NOT NULL AND r_share IS NOT NULL),
        cells AS (SELECT region, CAST(FLOOR(x / {step}) AS BIGINT) AS cx, CAST(FLOOR(y / {step}) AS BIGINT) AS cy, COUNT(*) AS n
                  FROM pts GROUP BY 1, 2, 3),
        bw AS (SELECT region, COUNT(*) AS total, {scott("x")} AS hx, {scott("y")} AS hy FROM pts GROUP BY region),
        ox AS (SELECT region, UNNEST(range(-CAST(ceil(4 * hx / {step}) AS BIGINT), CAST(ceil(4 * hx / {step}) AS BIGINT) + 1)) AS dx FROM bw),
        oy AS (SELECT region, UNNEST(range(-CAST(ceil(4 * hy / {step}) AS BIGINT), CAST(ceil(4 * hy / {step}) AS BIGINT) + 1)) AS dy FROM bw),
        reach AS (SELECT region, n, cx + dx AS gx, cy + dy AS gy, total, hx, hy, dx, dy
                  FROM cells JOIN bw USING (region) JOIN ox USING (region) JOIN oy USING (region)),
        kde AS (SELECT region, gx AS cell_x, gy AS cell_y,
                       SUM(n * exp(-0.5 * (pow(dx * {step} / hx, 2) + pow(dy * {step} / hy, 2)))) / MAX(2 * pi() * hx * hy * total) AS density
                FROM reach GROUP BY 1, 2, 3)"""


def _kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_density(standin.sections(spark, sf_dir), "a_share", "r_share", "region", 0.05)


@query("kernel_density", with_sections(_kernel_sql(0.05) + " SELECT region, cell_x, cell_y, ROUND(density, 6) AS density FROM kde"))
def q_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth density behind a joint plot, for every region."""
    return _kernel(spark, sf_dir).withColumn("density", F.round("density", 6))


@query(
    "kernel_lines",
    with_sections(
        _kernel_sql(0.05)
        + """, run AS (SELECT region, density, SUM(density) OVER (PARTITION BY region ORDER BY density DESC) AS run,
                             SUM(density) OVER (PARTITION BY region) AS total FROM kde)
           SELECT region, line, ROUND(MAX(CASE WHEN run >= (1 - p) * total THEN density END), 6) AS height
           FROM run, (VALUES (0, CAST(0.05 AS DOUBLE)), (1, CAST(0.525 AS DOUBLE)), (2, CAST(1 AS DOUBLE))) AS share(line, p)
           GROUP BY region, line"""
    ),
)
def q_kernel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the three contour lines of every region."""
    return mass_lines(_kernel(spark, sf_dir), "region").withColumn("height", F.round("height", 6))


@query("kernel_contours")
def q_kernel_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour segments of every region; the lines' heights come from the same grid."""
    density = _kernel(spark, sf_dir)
    return contours(density, mass_lines(density, "region"), "region", 0.05)
