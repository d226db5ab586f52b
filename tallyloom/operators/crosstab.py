"""Contingency tables with typed keys and an explicit bucket for NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import ROWS, Rows


def crosstab_long(df: DataFrame, rows: str, columns: str, name: str = "n", of: Rows = ROWS) -> DataFrame:
    """One row per pair of values that occurs, with its count; any cardinality."""
    return df.groupBy(rows, columns).agg(of.count().alias(name))


def crosstab_wide(
    df: DataFrame,
    rows: str,
    columns: str,
    values: Sequence,
    prefix: str | None = None,
    ordered: bool = False,
    of: Rows = ROWS,
) -> DataFrame:
    """One row per value of ``rows``, one count column per stated value of ``columns`` and one for all others.

    Column names are ``prefix`` (by default ``<columns>_``) and the value,
    ``null`` or ``other``; NULL counts as another value unless it is stated, so
    the cells of a row add up to its rows. Open domains are for
    ``crosstab_long``. The row key keeps its type, so ``ordered`` sorts numbers
    as numbers. Pairs are counted before they are spread, so the wide step sees
    at most one row per pair.
    """
    prefix = f"{columns}_" if prefix is None else prefix
    hits = {prefix + ("null" if v is None else str(v)): F.col(columns).eqNullSafe(F.lit(v)) for v in values}
    stated = reduce(Column.__or__, hits.values(), F.lit(False))
    cells = [F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name) for name, hit in hits.items()]
    cells.append(F.sum(F.when(stated, 0).otherwise(F.col("n"))).alias(f"{prefix}other"))
    out = crosstab_long(df, rows, columns, of=of).groupBy(rows).agg(*cells)
    return out.orderBy(F.asc_nulls_last(rows)) if ordered else out
