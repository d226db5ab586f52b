"""Grouped comparisons of two measures.

All reports aggregate to their grouping columns first; what is sorted and
shuffled afterwards is the report, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import ROWS, Rows

Dims = str | Sequence[str] | Mapping[str, Column]


def _dims(dims: Dims) -> tuple[list[str], list[Column]]:
    if isinstance(dims, str):
        dims = [dims]
    if isinstance(dims, Mapping):
        return list(dims), [expr.alias(name) for name, expr in dims.items()]
    return list(dims), [F.col(d) for d in dims]


def relative_difference(a: Column, b: Column, digits: int = 2) -> Column:
    """``a / b - 1`` rounded; NULL where ``b`` is 0."""
    return F.round(F.try_divide(a, b) - 1, digits)


def compare_by(
    df: DataFrame,
    dims: Dims,
    a: str,
    b: str,
    where: Column | None = None,
    count: str | None = None,
    stddev: bool = False,
    reverse: bool = False,
    digits: int = 2,
    ordered: bool = True,
    of: Rows = ROWS,
) -> DataFrame:
    """Sums of two measures per group with absolute and relative difference.

    ``dims`` are column names or ``{name: expression}``. ``reverse`` compares b
    to a, ``count`` names a row-count column, ``stddev`` adds the sample
    standard deviations. Largest relative difference first; ties by group.
    ``df`` has rows, or cells of a fold with ``of=CELLS``.
    """
    names, exprs = _dims(dims)
    if where is not None:
        df = df.where(where)
    aggs = [of.sum(a).alias(f"sum_{a}"), of.sum(b).alias(f"sum_{b}")]
    if stddev:
        aggs += [of.stddev(a).alias(f"stddev_{a}"), of.stddev(b).alias(f"stddev_{b}")]
    if count:
        aggs.append(of.count().alias(count))
    first, second = (b, a) if reverse else (a, b)
    x, y = F.col(f"sum_{first}"), F.col(f"sum_{second}")
    out = df.groupBy(*exprs).agg(*aggs).withColumns(
        {"dif_abs": x - y, "dif_rel": relative_difference(x, y, digits)}
    )
    return out.orderBy(F.desc("dif_rel"), *names) if ordered else out


def share_by(
    df: DataFrame,
    dims: Dims,
    a: str,
    b: str,
    total: str,
    where: Column | None = None,
    digits: int = 2,
    ordered: bool = True,
    of: Rows = ROWS,
) -> DataFrame:
    """Shares of two measures in a total, per group; the gap is taken before rounding."""
    names, exprs = _dims(dims)
    if where is not None:
        df = df.where(where)
    sums = df.groupBy(*exprs).agg(*[of.sum(c).alias(f"_{c}") for c in dict.fromkeys([a, b, total])])
    share_a = F.try_divide(F.col(f"_{a}"), F.col(f"_{total}"))
    share_b = F.try_divide(F.col(f"_{b}"), F.col(f"_{total}"))
    out = sums.select(
        *names,
        F.round(share_a, digits).alias(f"share_{a}"),
        F.round(share_b, digits).alias(f"share_{b}"),
        F.round(share_a - share_b, digits).alias("dif"),
    )
    return out.orderBy(F.desc("dif"), *names) if ordered else out


def having_mixed_groups(
    df: DataFrame,
    key: str,
    a: str,
    b: str,
    labels: Sequence[str],
    size: str,
    max_size: int,
    flag: str,
    with_name: str = "n_with",
    without_name: str = "n_without",
    digits: int = 2,
    ordered: bool = True,
    of: Rows = ROWS,
) -> DataFrame:
    """Groups that hold rows both with and without ``flag`` and whose summed size is within a limit.

    The limit is on the *sum* per group. ``labels`` are descriptive columns of
    which the largest value is shown.
    """
    out = (
        df.groupBy(key)
        .agg(
            *[of.max(c).alias(c) for c in labels],
            of.count().alias("total"),
            of.sum(size).alias(f"sum_{size}"),
            of.count_where(F.col(flag) == 1).alias(with_name),
            of.count_where(F.col(flag) == 0).alias(without_name),
            of.sum(a).alias(f"sum_{a}"),
            of.sum(b).alias(f"sum_{b}"),
        )
        .where((F.col(f"sum_{size}") <= max_size) & (F.col(with_name) > 0) & (F.col(without_name) > 0))
    )
    x, y = F.col(f"sum_{a}"), F.col(f"sum_{b}")
    out = out.withColumns({"dif_abs": x - y, "dif_rel": relative_difference(x, y, digits)})
    return out.orderBy(F.desc("total"), key) if ordered else out


def sum_pair_by_group(
    df: DataFrame, dims: Dims, a: str, b: str, where: Column | None = None, total: bool = False, of: Rows = ROWS
) -> DataFrame:
    """Two sums per group with their difference, or with their total instead."""
    _, exprs = _dims(dims)
    if where is not None:
        df = df.where(where)
    x, y = of.sum(a), of.sum(b)
    return df.groupBy(*exprs).agg(x.alias(f"sum_{a}"), y.alias(f"sum_{b}"), (x + y).alias("total") if total else (x - y).alias("dif"))
