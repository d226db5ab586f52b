"""Row counts, column profiles and schema checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import SENTINEL


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for each table, in one job; a table without rows counts 0."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


_SHORT = (T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
_VALUE, _ABSENT, _SENTINEL = 0, 1, 2


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _identity(field: T.StructField) -> tuple[str, str]:
    """SQL of two integers that differ when the column's values do.

    For types of 64 bits at most the first alone is exact, since the hash of one
    such value can be inverted (it takes -0.0 as 0.0 and all NaN as one). Other
    values have 128 bits of two hashes.
    """
    column, kind = _quoted(field.name), field.dataType
    if isinstance(kind, _SHORT) and not (isinstance(kind, T.DecimalType) and kind.precision > 18):
        return f"xxhash64({column})", "0L"
    if not isinstance(kind, T.AtomicType):
        column = f"to_json(struct({column} AS v))"
    return f"xxhash64({column})", f"xxhash64(1, {column})"


def _melted(df: DataFrame, first: int, sentinel: str, exact: set[str]) -> DataFrame:
    """One narrow row per value: the number of its column, its kind, and its identity where that is asked for.

    Stated as SQL text: a wide table takes one call per column, not one per expression.
    """
    values = []
    for i, f in enumerate(df.schema.fields):
        column = _quoted(f.name)
        hit = f"WHEN {column} = {_literal(sentinel)} THEN {_SENTINEL}" if isinstance(f.dataType, T.StringType) else ""
        one, two = _identity(f) if f.name in exact else ("0L", "0L")
        values.append(
            f"named_struct('column', {first + i}, 'kind', CASE WHEN {column} IS NULL THEN {_ABSENT} {hit} ELSE {_VALUE} END, "
            f"'one', {one}, 'two', {two}) AS c{i}"
        )
    return df.selectExpr(*values).unpivot([], [f"c{i}" for i in range(len(values))], "name", "value").select("value.*")


def schema_profile(
    tables: Mapping[str, DataFrame] | DataFrame, sentinel: str = SENTINEL, distinct: Sequence[str] | str = ()
) -> DataFrame:
    """Per column: type, rows, NULLs, sentinels and, where asked for, exact distinct values.

    ``distinct`` names the columns whose distinct values are counted, or is
    ``"all"``; the others have NULL there. Every table is scanned once: its
    values become narrow rows that are counted by column and identity, first in
    the map tasks, so that a frequent value is one row per task. Columns that
    are not named have no identity and hardly reach the shuffle. A table without
    rows shows its columns with zeros.
    """
    if isinstance(tables, DataFrame):
        tables = {"table": tables}
    listed, melted = [], []
    for name, df in tables.items():
        exact = {f.name for f in df.schema.fields if distinct == "all" or f.name in distinct}
        if df.columns:
            melted.append(_melted(df, len(listed), sentinel, exact))
        for i, f in enumerate(df.schema.fields):
            listed.append((len(listed), i, name, f.name, f.dataType.simpleString(), f.name in exact))
    if not melted:
        raise ValueError("no table has a column")
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(
        listed, "column int, position int, table_name string, column_name string, column_type string, counted boolean"
    )
    by_value = reduce(DataFrame.unionByName, melted).groupBy("column", "kind", "one", "two").agg(F.count(F.lit(1)).alias("n"))
    found = by_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("kind") == _ABSENT, F.col("n"))).alias("n_nulls"),
        F.sum(F.when(F.col("kind") == _SENTINEL, F.col("n"))).alias("n_sentinels"),
        F.count(F.when(F.col("kind") != _ABSENT, 1)).alias("n_distinct"),
    )
    counts = {n: F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_rows", "n_nulls", "n_sentinels", "n_distinct")}
    counts["n_distinct"] = F.when(F.col("counted"), counts["n_distinct"]).alias("n_distinct")
    return columns.join(found, "column", "left").select(
        "table_name", "position", "column_name", "column_type", *counts.values()
    )


def sketch_profile(df: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), k: int = 5, rsd: float = 0.02) -> DataFrame:
    """Per column: rows, NULLs, estimated distinct values, quantiles and most frequent values, from one scan.

    All states are sketches of fixed size that merge, so the shuffle holds one
    row per task whatever the data: distinct values by HyperLogLog with relative
    standard deviation ``rsd``, quantiles of number columns with rank error
    1/10000 (others and columns without values have NULL), and up to ``k``
    frequent values as text with estimated counts, most frequent first. NULLs
    have their own count and are no frequent value.
    """
    fields = df.schema.fields
    states = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        column = F.col(f"`{f.name}`")
        text = column.cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(column.alias("v")))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = (column + F.lit(0.0).cast(f.dataType)).cast("string")  # -0.0 is 0.0
        text = F.when(column.isNotNull(), text)
        states.append(F.count(column).alias(f"v{i}"))
        states.append(F.approx_count_distinct(text, rsd).alias(f"d{i}"))
        # NULL is a value of its own to the sketch: one more is kept, and left out below.
        states.append(F.expr(f"approx_top_k(_text_{i}, {k + 1})").alias(f"t{i}"))
        if isinstance(f.dataType, T.NumericType):
            states.append(F.percentile_approx(column.cast("double"), list(quantiles), 10_000).alias(f"q{i}"))
        df = df.withColumn(f"_text_{i}", text)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"v{i}")).alias("n_nulls"),
            F.col(f"d{i}").alias("approx_distinct"),
            (F.col(f"q{i}") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("array<double>")).alias("quantiles"),
            F.slice(F.filter(F.col(f"t{i}"), lambda v: v["item"].isNotNull()), 1, k).alias("frequent"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*states).select(F.inline(F.array(*rows)))


def schema_differences(df: DataFrame, declared: T.StructType) -> list[str]:
    """What differs from a declared schema: missing, unexpected and differently typed columns."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in declared.fields}
    found = [f"missing {n}" for n in want if n not in have]
    found += [f"unexpected {n}" for n in have if n not in want]
    found += [
        f"{n}: {have[n].simpleString()} instead of {t.simpleString()}"
        for n, t in want.items()
        if n in have and have[n] != t
    ]
    return found


__all__: Sequence[str] = ("row_counts", "schema_differences", "schema_profile", "sketch_profile")
