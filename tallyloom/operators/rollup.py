"""One fold of a table that answers many grouped reports.

``fold`` reads the rows once and keeps, for each of several sets of columns, a cell per combination of values with row counts, sums, counts of
values, sums of squares and maxima. All of these add up, so that a report over fewer columns is a fold of cells. ``Folds`` answers
a report from the smallest set that holds its columns.

The operators for reports take rows or cells alike: their argument ``of`` says which, and ``Cells`` has the aggregate
for each that ``Rows`` has.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import StageStore

SET, ROWS_IN = "cell_set", "cell_rows"


class Rows:
    """Aggregates of detail rows."""

    def count(self) -> Column:
        return F.count(F.lit(1))

    def count_where(self, condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    def sum(self, name: str) -> Column:
        return F.sum(name)

    def max(self, name: str) -> Column:
        return F.max(name)

    def stddev(self, name: str) -> Column:
        return F.stddev_samp(name)


class Cells(Rows):
    """The same aggregates of the cells that ``fold`` makes."""

    def count(self) -> Column:
        return F.sum(ROWS_IN)

    def count_where(self, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(ROWS_IN)).otherwise(0))

    def sum(self, name: str) -> Column:
        return F.sum(f"sum_{name}")

    def max(self, name: str) -> Column:
        return F.max(f"max_{name}")

    def stddev(self, name: str) -> Column:
        n, total, squares = (F.sum(f"{kind}_{name}") for kind in ("count", "total", "square"))
        # Whole numbers are decimals here, and the difference is exact.
        spread = F.greatest((n * squares - total * total).cast("double"), F.lit(0.0))
        return F.when(n > 1, F.sqrt(spread / n.cast("double") / (n - 1).cast("double")))


ROWS, CELLS = Rows(), Cells()


def _wide(df: DataFrame, name: str) -> Column:
    """A measure for exact sums of squares: whole numbers as decimals, others as doubles."""
    kind = df.schema[name].dataType
    return F.col(name).cast("decimal(19,0)" if isinstance(kind, T.IntegralType) else "double")


def _first_sums(sums: Sequence[str], squares: Sequence[str]) -> list[Column]:
    """What adds up in a cell, from rows."""
    aggs = [F.count(F.lit(1)).alias(ROWS_IN), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in dict.fromkeys([*sums, *squares]))]
    for c in squares:
        exact = F.col(f"square_{c}")
        aggs += [
            F.count(exact).alias(f"count_{c}"),
            F.sum(exact).alias(f"total_{c}"),
            F.sum(exact * exact).alias(f"square_{c}"),
        ]
    return aggs


def _cell_sums(sums: Sequence[str], squares: Sequence[str], types: Mapping[str, T.DataType]) -> list[Column]:
    """The same from finer cells, in the same types."""
    names = [ROWS_IN, *(f"sum_{c}" for c in dict.fromkeys([*sums, *squares]))]
    names += [f"{kind}_{c}" for c in squares for kind in ("count", "total", "square")]
    return [F.sum(n).cast(types[n]).alias(n) for n in names]


def fold(
    df: DataFrame,
    dims: Mapping[str, Column | str],
    sets: Sequence[Iterable[str]],
    sums: Sequence[str] = (),
    squares: Sequence[str] = (),
    maxima: Sequence[str] = (),
) -> DataFrame:
    """The cells of each of ``sets`` of ``dims`` from one reading of ``df``.

    ``cell_set`` numbers the set; dims that are not in it are NULL, and NULL is a value of those that are. ``cell_rows`` counts
    rows; each measure of ``sums`` has ``sum_``, those of ``squares`` also ``count_``, ``total_`` and ``square_``, those of ``maxima`` ``max_``.
    """
    dims = {name: F.col(e) if isinstance(e, str) else e for name, e in dims.items()}
    sets = [frozenset(s) for s in sets]
    if len(set(sets)) < len(sets) or not set().union(*sets) <= set(dims):
        raise ValueError("sets must differ and hold declared dims only")
    measures = {f"sum_{c}": F.col(c) for c in dict.fromkeys([*sums, *squares])}
    measures |= {f"square_{c}": _wide(df, c) for c in squares} | {f"max_{c}": F.col(c) for c in maxima}
    names = list(dims)
    rows = df.select(*(e.alias(n) for n, e in dims.items()), *(e.alias(n) for n, e in measures.items()))
    if any(isinstance(rows.schema[f"max_{c}"].dataType, (T.StringType, T.BinaryType)) for c in maxima):
        # The greatest text has no state of fixed width, and its fold would sort every row once per set. As keys the texts
        # are hashed, and only the finest cells are sorted.
        finest = rows.groupBy(*names, *(f"max_{c}" for c in maxima)).agg(*_first_sums(sums, squares))
        final = _cell_sums(sums, squares, {f.name: f.dataType for f in finest.schema.fields})
        rows = finest
    else:
        final = _first_sums(sums, squares)
    aggs = [*final, *(F.max(f"max_{c}").alias(f"max_{c}") for c in maxima)]
    grouped = rows.groupingSets([[F.col(n) for n in names if n in s] for s in sets], *map(F.col, names))
    # A bit per column that a set does not hold, the first column highest.
    bits = {s: sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s) for s in sets}
    number = F.lit(None).cast("int")
    for k, s in enumerate(sets):
        number = F.when(F.col(SET) == bits[s], F.lit(k)).otherwise(number)
    return grouped.agg(F.grouping_id().alias(SET), *aggs).withColumn(SET, number)


def whole_as_long(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact whole sums as ``bigint``; a column with a sum beyond its range keeps its decimals.

    Reads ``cells`` once, so give it a stored stage.
    """
    small = [F.coalesce(F.bool_and(F.col(c).try_cast("long").isNotNull() | F.col(c).isNull()), F.lit(True)).alias(c) for c in columns]
    fits = cells.agg(*small).first()
    return cells.withColumns({c: F.col(c).cast("long") for c in columns if fits[c]})


@dataclass
class Folds:
    """Stored cells and, of each set, its dims and number of cells."""

    cells: DataFrame
    sets: list[frozenset[str]]
    sizes: list[int]

    @classmethod
    def store(cls, store: StageStore, name: str, df: DataFrame, dims: Mapping, sets: Sequence[Iterable[str]], **measures) -> Folds:
        """Fold ``df`` once and keep the cells as a stage."""
        cells = store.write(name, fold(df, dims, sets, **measures))
        found = {r[SET]: r["n"] for r in cells.groupBy(SET).agg(F.count("*").alias("n")).collect()}  # a row per set
        return cls(cells, [frozenset(s) for s in sets], [found.get(k, 0) for k in range(len(sets))])

    def smallest(self, columns: Iterable[str]) -> DataFrame:
        """The cells of the set with the fewest cells of those that hold the columns."""
        fitting = [(self.sizes[k], k) for k, s in enumerate(self.sets) if set(columns) <= s]
        if not fitting:
            raise ValueError(f"no fold holds {sorted(columns)}")
        return self.cells.where(F.col(SET) == min(fitting)[1])
