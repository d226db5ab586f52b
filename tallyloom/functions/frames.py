"""Small whole-frame projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derive import floor_positive


def cast_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn code columns into text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop in one projection; names that are absent are ignored."""
    return df.drop(*columns)


def filter_equal(df: DataFrame, **conditions) -> DataFrame:
    """Keep rows equal to every given value; reaches the scan as pushed filters."""
    for column, value in conditions.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def floor_positive_columns(df: DataFrame, renamed: dict[str, str], floor: float = 0.001) -> DataFrame:
    """Add ``new`` = positive floor of ``old`` for each ``{old: new}``."""
    return df.withColumns({new: floor_positive(old, floor) for old, new in renamed.items()})


def null_audit(
    df: DataFrame, column: str, show: Sequence[str], order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Rows where ``column`` is NULL; with ``limit`` the first so many in a stated order."""
    hits = df.where(F.col(column).isNull()).select(*show)
    return hits.orderBy(*order).limit(limit) if limit is not None else hits
