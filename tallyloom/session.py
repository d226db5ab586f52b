"""Session set-up and scoped caching."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: wall-clock timestamps do not move with the
# machine's zone, and AQE sizes partitions, converts joins whose side turns out
# small and splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the split costs a further shuffle, as in a chain
    # of joins on one key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A generated method beyond this size is never compiled by the JVM; Spark then
    # uses smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(app_name: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep ``df`` cached inside the block only."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
