"""Set-up for tasks in Python, and tables in the folder that the whole cluster shares."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the session's warehouse, which on a cluster must be shared, too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as parquet to the shared folder and read again, and the folder: later jobs start from the files."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# Keys up to this number are sent to every executor (some 40 MB).
BROADCAST_ROWS = 1_000_000


def small_side(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcasting if counted to be ``BROADCAST_ROWS`` at most; else the join shuffles, same result."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def prepare(spark: SparkSession) -> None:
    """Let executors import this package, and keep Arrow batches small enough for very long texts.

    The package goes to the shared folder as one archive, once per application.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    target = context._jvm.org.apache.hadoop.fs.Path(f"{fresh_folder(spark, 'code')}/{package.name}.zip")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())
    _shipped.add(context.applicationId)
