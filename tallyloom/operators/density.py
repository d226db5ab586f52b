"""Joint and marginal distributions as counted cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(value: str, width: float) -> Column:
    return F.floor(F.col(value) / F.lit(float(width)))


def density_grid(
    df: DataFrame, x: str, y: str, width_x: float, width_y: float, hue: str | None = None
) -> DataFrame:
    """Rows per cell of an equal-width grid, by ``hue``; points with a NULL coordinate have no cell."""
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    by = ([F.col(hue)] if hue else []) + [_bin(x, width_x).alias("cell_x"), _bin(y, width_y).alias("cell_y")]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def marginal_histogram(df: DataFrame, x: str, width: float, hue: str | None = None) -> DataFrame:
    """Rows per bucket of one measure, by ``hue``."""
    by = ([F.col(hue)] if hue else []) + [_bin(x, width).alias("bucket")]
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def iso_proportions(levels: int, thresh: float = 0.05) -> list[float]:
    """``levels`` evenly spaced mass shares from ``thresh`` to 1."""
    if levels < 2:
        return [thresh]
    return [thresh + (1.0 - thresh) * i / (levels - 1) for i in range(levels)]


def density_levels(grid: DataFrame, hue: str, levels: int = 3, thresh: float = 0.05) -> DataFrame:
    """Give each grid cell its density level.

    The line for share p runs at the largest cell count at which the cells at
    least that dense still hold the share 1 - p of the group's rows; a cell's
    level is the number of lines it reaches, 0 for the sparsest. Cells with equal
    counts get equal levels.

    The running mass is taken over *distinct cell counts*. A group of N rows
    has at most sqrt(2 N) of those, so the window stays small however fine the
    grid is. Only the lines, one row per group, are joined back.
    """
    shares = iso_proportions(levels, thresh)
    by_count = grid.groupBy(hue, "n").agg(F.sum("n").alias("mass"))
    denser = Window.partitionBy(hue).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(hue)
    running = by_count.select(
        hue, "n", F.sum("mass").over(denser).alias("running"), F.sum("mass").over(whole).alias("total")
    )
    lines = running.groupBy(hue).agg(
        *[
            F.max(F.when(F.col("running") >= F.lit(1.0 - p) * F.col("total"), F.col("n"))).alias(f"_line_{i}")
            for i, p in enumerate(shares)
        ]
    )
    level = sum(F.when(F.col("n") >= F.col(f"_line_{i}"), 1).otherwise(0) for i in range(len(shares)))
    cells, line = grid.alias("cells"), lines.alias("lines")
    joined = cells.join(line, F.col(f"cells.{hue}").eqNullSafe(F.col(f"lines.{hue}")), "inner")
    return joined.select("cells.*", level.alias("level"))


def joint_distribution(
    df: DataFrame, x: str, y: str, hue: str, width: float = 0.02, levels: int = 3, thresh: float = 0.05
) -> dict[str, DataFrame]:
    """The three layers of a joint plot: leveled cells and both marginals."""
    grid = density_grid(df, x, y, width, width, hue)
    return {
        "cells": density_levels(grid, hue, levels, thresh),
        "marginal_x": marginal_histogram(df, x, width, hue),
        "marginal_y": marginal_histogram(df, y, width, hue),
    }


__all__: Sequence[str] = (
    "density_grid",
    "density_levels",
    "iso_proportions",
    "joint_distribution",
    "marginal_histogram",
)
