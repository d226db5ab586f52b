"""Stored stages: results written once and read by everything after them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share: the one the session names in ``spark.checkpoint.dir``, else its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


class StageStore:
    """Named parquet stages under one root; the same name is written and read."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_root(spark)}/stages-{uuid4().hex}").rstrip("/")
        self._tables: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> DataFrame:
        """Store ``df`` and return it as read back, with its lineage cut there."""
        df.write.mode(mode).partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(_nullable(df.schema)).parquet(self.path(name))

    def write_bucketed(self, name: str, df: DataFrame, keys: Sequence[str], buckets: int, sort: bool = True) -> DataFrame:
        """Store ``df`` dealt into ``buckets`` by ``keys``, sorted by them within each file, and return it as read back.

        Joins and folds by ``keys`` (or more columns) of stages with the same
        keys and number of buckets need no shuffle. The rows are shuffled once
        here, by the hash that the buckets use, so that a bucket is one file; all
        rows of a key are in one bucket, so store folded rows rather than detail
        with hot keys. The stage is a table of the session's catalog over the
        stage's folder, named by the last part of the root and ``name``.
        """
        if buckets < 1 or not keys:
            raise ValueError("buckets must be positive and keys not empty")
        label = re.sub(r"[^0-9a-z_]", "_", f"{self.root.rsplit('/', 1)[-1]}_{name}".lower())
        writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
        if sort:
            writer = writer.sortBy(*keys)
        writer.option("path", self.path(name)).saveAsTable(label)
        self._tables.append(label)
        return self.spark.table(label)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def remove(self) -> None:
        """Delete the stages; call it when nothing reads them any more."""
        for label in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{label}`")
        self._tables.clear()
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def register(**tables: DataFrame) -> None:
    """Name results for use from SQL text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
