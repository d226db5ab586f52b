"""Delimited text with a header, read against a declared schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import StageStore


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    null_value: str | None = None,
    by_name: bool = True,
    file_glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Scan files or globs into ``schema``, without inferring types.

    ``by_name`` binds columns by the header, so files may hold more columns and
    another order. All files under one path have one layout: the header of one
    is read ahead, and a file with another fails the job when it is read. Files
    of several layouts are given as a list of paths, one or more per layout.
    Otherwise columns are bound by position. A value that does not fit its declared type is NULL, and
    text columns keep their text: leading zeros, clock times and sentinels. With
    ``null_value`` a sentinel is read as NULL instead, which makes it the same
    as an absent value to everything downstream.
    """
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE")
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if file_glob is not None:
        reader = reader.option("pathGlobFilter", file_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if not by_name:
        return reader.schema(schema).csv(path)
    paths = [path] if isinstance(path, str) else path
    parts = [_by_header(reader.option("enforceSchema", False).csv(p), p, schema) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def _by_header(text: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return text.select(
        *[
            F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


# Columns that ``checked_lines`` adds: where a row comes from, its text if the fields do not match the header, and the
# values that do not fit their types.
SOURCE = ("_file", "_line", "_problems")


def checked_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    null_value: str | None = None,
    file_glob: str | None = None,
) -> DataFrame:
    """Every line of the files, bound by header, with what is wrong with it.

    Columns: those of ``schema``, then ``_file``; ``_line``, the raw text of a line
    with fewer or more fields than the header, else NULL; and ``_problems``, an
    array of (column, raw) for values that do not fit the declared type (empty
    for a good line; a malformed line is not judged by value). An absent value
    is no problem. Paths are as in ``read_delimited``: one layout each, and a
    file with another header fails the job. Blank lines are no lines.
    """
    clash = [c for c in SOURCE if c in schema.fieldNames()]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    options = {"header": True, "sep": sep, "encoding": encoding, "mode": "PERMISSIVE", "enforceSchema": False}
    options |= {k: v for k, v in {"nullValue": null_value, "pathGlobFilter": file_glob}.items() if v is not None}
    parts = []
    for p in [path] if isinstance(path, str) else path:
        header = spark.read.options(**options).csv(p).columns
        missing = [n for n in schema.fieldNames() if n not in header]
        if missing:
            raise ValueError(f"columns missing from {p}: {missing}")
        raw = T.StructType([T.StructField(n, T.StringType()) for n in (*header, "_line")])
        # Fields are counted only where all columns are parsed.
        text = spark.read.options(**options, columnNameOfCorruptRecord="_line", columnPruning=False).schema(raw).csv(p)
        values, problems = [], []
        for f in schema.fields:
            column = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StringType):
                values.append(column)
                continue
            value = column.try_cast(f.dataType)
            values.append(value.alias(f.name))
            wrong = F.col("_line").isNull() & column.isNotNull() & value.isNull()
            problems.append(F.when(wrong, F.struct(F.lit(f.name).alias("column"), column.alias("raw"))))
        found = F.array_compact(F.array(*problems)) if problems else F.lit(None)
        found = F.coalesce(found.cast("array<struct<column:string,raw:string>>"), F.expr("CAST(array() AS array<struct<column:string,raw:string>>)"))
        parts.append(text.select(*values, F.col("_metadata.file_path").alias("_file"), "_line", found.alias("_problems")))
    return reduce(DataFrame.unionByName, parts)


def quarantine(store: StageStore, name: str, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store ``lines`` of ``checked_lines`` once, and return its good rows and its bad lines.

    The text is read in one pass: the stage is partitioned by whether a line is
    bad, and either result reads its own folder. Good rows have the declared
    columns. Bad lines have ``file``, ``line`` (the raw text of a malformed line)
    and ``problems`` (column and raw text of each value that did not parse); the
    two together are all lines read.
    """
    bad = F.col("_line").isNotNull() | (F.size("_problems") > 0)
    stage = store.write(name, lines.withColumn("_bad", bad), partition_by=["_bad"])
    declared = [c for c in lines.columns if c not in SOURCE]
    good = stage.where(~F.col("_bad")).select(*[F.col(f"`{c}`") for c in declared])
    rejected = stage.where("_bad").select(*[F.col(c).alias(c[1:]) for c in SOURCE])
    return good, rejected


def rejects_by_column(rejected: DataFrame) -> DataFrame:
    """(file, column, n_values, example): how many values of a column did not parse, and the smallest of them.

    Malformed lines count under the column NULL, with their text as value.
    """
    malformed = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("line").alias("raw")))
    found = rejected.select("file", F.inline(F.when(F.col("line").isNull(), F.col("problems")).otherwise(malformed)))
    return found.groupBy("file", "column").agg(F.count(F.lit(1)).alias("n_values"), F.min("raw").alias("example"))
