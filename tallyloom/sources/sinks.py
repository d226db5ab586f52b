"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def sorted_layout(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by ``keys``, so that files are in key order.

    The number of the producing task takes part in the ranges: a key value that
    fills a third of the table is spread over several files instead of one. It
    is fixed per task, so a retried task makes the same ranges.
    """
    salted = df.withColumn("_task", F.spark_partition_id())
    columns = [*keys, "_task"]
    ranged = salted.repartitionByRange(partitions, *columns) if partitions else salted.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns).drop("_task")


def write_sorted(
    df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None, mode: str = "overwrite"
) -> None:
    """Parquet in global key order, in ``partitions`` files at most."""
    sorted_layout(df, keys, partitions).write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """One parquet folder per value; every task writes its own part of each, without a shuffle."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_delimited(
    df: DataFrame,
    path: str,
    sep: str = ";",
    encoding: str = "UTF-8",
    mode: str = "overwrite",
) -> None:
    """Delimited text: a folder of part files with a header each, which readers take as one table."""
    df.write.mode(mode).options(header=True, sep=sep, encoding=encoding).csv(path)
