"""Smooth joint densities on a grid, and their contour lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .density import iso_proportions

# A Gaussian is followed for so many bandwidths to either side.
REACH = 4


def kernel_density(df: DataFrame, x: str, y: str, hue: str, width: float) -> DataFrame:
    """Gaussian kernel density of (x, y) by ``hue`` at the centres of a square grid: (hue, cell_x, cell_y, density).

    Points are counted in cells, and with them the moments that give the
    bandwidths: by Scott's rule, sample deviation times n ** (-1/6), for either
    axis, and half a cell at least (also for one point or equal points). The
    kernel is separable, so the cells are spread along x and the sums along y:
    rows are cells times offsets, never points, and are summed first in the map
    tasks. Points with a NULL, NaN or infinite coordinate are left out; NULL is a
    ``hue`` of its own. Cells that no point reaches are absent. Deviations come
    from sums of squares: shift coordinates whose mean is 10^5 deviations and more.
    """
    if width <= 0:
        raise ValueError("width must be positive")

    def finite(c: str) -> Column:
        return F.abs(F.col(c).cast("double")) < F.lit(math.inf)

    points = df.where(finite(x) & finite(y)).select(
        F.col(hue).alias("_hue"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    cells = points.groupBy("_hue", F.floor(F.col("_x") / width).alias("cx"), F.floor(F.col("_y") / width).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(s).alias(n) for n, s in {"x1": "sum(_x)", "x2": "sum(_x * _x)", "y1": "sum(_y)", "y2": "sum(_y * _y)"}.items()],
    )
    sums = cells.groupBy("_hue").agg(*[F.sum(c).alias(f"s_{c}") for c in ("n", "x1", "x2", "y1", "y2")])

    def bandwidth(axis: str) -> str:
        spread = f"sqrt(greatest(s_{axis}2 - s_{axis}1 * s_{axis}1 / s_n, 0D) / (s_n - 1))"
        return f"CASE WHEN s_n > 1 THEN greatest({spread} * pow(s_n, -1D / 6), {width / 2}D) ELSE {width / 2}D END"

    widths = sums.select(F.col("_hue").alias("_of"), "s_n", F.expr(bandwidth("x")).alias("hx"), F.expr(bandwidth("y")).alias("hy"))
    spread = cells.join(widths, F.col("_hue").eqNullSafe(F.col("_of"))).drop("_of")
    for axis, mass in (("x", "n"), ("y", "mass")):
        reach = f"CAST(ceil({REACH} * h{axis} / {width}D) AS BIGINT)"
        reached = spread.selectExpr("*", f"explode(sequence(-{reach}, {reach})) AS d")
        weight = f"exp(-0.5D * pow(d * {width}D / h{axis}, 2)) / (h{axis} * sqrt(2 * pi()))"
        other = "cy" if axis == "x" else "cx"
        moved = reached.selectExpr("_hue", "s_n", "hx", "hy", other, f"c{axis} + d AS c{axis}", f"{mass} * {weight} AS part")
        spread = moved.groupBy("_hue", "s_n", "hx", "hy", "cx", "cy").agg(F.sum("part").alias("mass"))
    return spread.select(
        F.col("_hue").alias(hue), F.col("cx").alias("cell_x"), F.col("cy").alias("cell_y"), (F.col("mass") / F.col("s_n")).alias("density")
    )


def mass_lines(density: DataFrame, hue: str, levels: int = 3, thresh: float = 0.05) -> DataFrame:
    """(hue, line, height): the density at which the cells at least that dense hold the share 1 - p of the mass.

    The shares p are those of ``iso_proportions``; the last, p = 1, is the peak.
    The running sum of a group is over grid cells, whose number the grid bounds.
    """
    cells = density.select(F.col(hue).alias("_hue"), "density")
    denser = Window.partitionBy("_hue").orderBy(F.desc("density"))
    running = cells.select(
        "_hue", "density", F.sum("density").over(denser).alias("run"), F.sum("density").over(Window.partitionBy("_hue")).alias("total")
    )
    shares = iso_proportions(levels, thresh)
    heights = [
        F.coalesce(F.max(F.when(F.col("run") >= (1.0 - p) * F.col("total"), F.col("density"))), F.min("density")).alias(f"line_{i}")
        for i, p in enumerate(shares)
    ]
    lines = running.groupBy("_hue").agg(*heights)
    rows = F.array(*[F.struct(F.lit(i).alias("line"), F.col(f"line_{i}").alias("height")) for i in range(len(shares))])
    return lines.select(F.col("_hue").alias(hue), F.inline(rows))


def contours(density: DataFrame, lines: DataFrame, hue: str, width: float) -> DataFrame:
    """Contour segments (hue, line, x0, y0, x1, y1) of the grid at every height, by marching squares.

    A square has the centres of four cells that meet as corners; absent cells
    have density 0. Where the line cuts all four edges, the mean of the corners
    tells which pair belongs together. A corner exactly at the height is inside.
    """
    corners = F.expr(
        "inline(array(" + ", ".join(f"struct(cell_x - {i} AS bx, cell_y - {j} AS by, {i + 2 * j} AS corner)" for j in (0, 1) for i in (0, 1)) + "))"
    )
    squares = density.select(F.col(hue).alias("_hue"), "density", corners).groupBy("_hue", "bx", "by").agg(
        *[F.expr(f"coalesce(max(CASE WHEN corner = {i + 2 * j} THEN density END), 0D)").alias(f"v{i}{j}") for j in (0, 1) for i in (0, 1)]
    )
    cut = squares.join(
        lines.select(F.col(hue).alias("_of"), "line", "height").where("height > 0"), F.col("_hue").eqNullSafe(F.col("_of"))
    ).where("least(v00, v10, v01, v11) < height AND greatest(v00, v10, v01, v11) >= height")

    def crossing(a: str, b: str, px: str, py: str) -> str:
        at = f"((height - {a}) / ({b} - {a}))"
        px, py = px.replace("t", at), py.replace("t", at)
        point = f"struct((bx + 0.5D + {px}) * {width}D AS x, (by + 0.5D + {py}) * {width}D AS y)"
        return f"CASE WHEN ({a} >= height) <> ({b} >= height) THEN {point} END"

    edges = cut.selectExpr(
        "_hue", "line",
        "(v00 + v10 + v01 + v11) / 4 >= height = (v00 >= height) AS joined",
        f"{crossing('v00', 'v10', 't', '0D')} AS b",
        f"{crossing('v10', 'v11', '1D', 't')} AS r",
        f"{crossing('v01', 'v11', 't', '1D')} AS u",
        f"{crossing('v00', 'v01', '0D', 't')} AS l",
    )
    pairs = edges.selectExpr(
        "_hue", "line",
        """explode(CASE WHEN b IS NULL OR r IS NULL OR u IS NULL OR l IS NULL THEN array(array_compact(array(b, r, u, l)))
                        WHEN joined THEN array(array(b, r), array(u, l)) ELSE array(array(b, l), array(r, u)) END) AS s""",
    )
    return pairs.selectExpr("_hue", "line", "s[0].x AS x0", "s[0].y AS y0", "s[1].x AS x1", "s[1].y AS y1").withColumnRenamed("_hue", hue)
