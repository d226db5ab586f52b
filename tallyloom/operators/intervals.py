"""Joins of whole numbers with a table of intervals, without comparing all with all.

An interval belongs to a level: cells of 2^level numbers, the smallest that an interval of its length fits into so that it touches two cells
at most. A number has one cell on each level that the table uses. Number and interval meet by (level, cell), an ordinary
equi-join, and are then compared exactly. Levels are 64 at most, whatever the table.

Where matches are only folded, they are not listed, for long intervals match without end. An interval is then cut into whole cells
of 8^tier numbers, 14 at most on a tier. Totals of the numbers in a cell, or the first of the intervals that
hold it, are one row per cell, however many numbers and intervals share it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
# A level of all numbers, for intervals that are longer than half of them.
TOP = 63
# Bits per tier, the last tier, and the tiers on which single numbers are looked up; the tiers above take blocks of them.
STEP, LAST, FINE = 3, 21, 3


def _cell(value: Column, level: Column) -> Column:
    """``value`` divided by 2^level, rounded down; one cell for all numbers on the top level."""
    shifted = F.call_function("shiftright", value, level.cast("int"))
    return F.when(level >= TOP, F.lit(0).cast("long")).otherwise(shifted)


def _fresh(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name


def cells_of(ranges: DataFrame, low: str, high: str, level: str = "level", cell: str = "cell") -> DataFrame:
    """``ranges`` with closed ends (NULL is open), each row once for every cell that it touches. Empty intervals have no cell."""
    a = F.coalesce(F.col(low).cast("long"), F.lit(LOWEST))
    b = F.coalesce(F.col(high).cast("long"), F.lit(HIGHEST))
    # Rounding may only raise a level.
    length = b.cast("decimal(20,0)") - a.cast("decimal(20,0)") + 1
    fitting = F.ceil(F.log2(length.cast("double")) + F.lit(1e-9)).cast("int")
    ends = F.array_distinct(F.array(_cell(a, F.col(level)), _cell(b, F.col(level))))
    rows = ranges.where(a <= b).withColumn(level, F.greatest(F.lit(0), F.least(F.lit(TOP), fitting)))
    return rows.withColumn(cell, F.explode(ends))


def _shifted(value: Column, shift: Column | int) -> Column:
    return F.call_function("shiftright", value, F.lit(shift) if isinstance(shift, int) else shift.cast("int"))


def _whole(a: Column, b: Column, shift: Column) -> tuple[Column, Column]:
    """First and last of the cells of 2^shift numbers that lie in a closed interval as a whole; none if the first is higher."""
    up, down = _shifted(a, shift), _shifted(b, shift)
    cut_a = F.call_function("shiftleft", up, shift) != a
    cut_b = F.call_function("shiftleft", _shifted(F.bitwise_not(b), shift), shift) != F.bitwise_not(b)
    return up + F.when(cut_a, 1).otherwise(0), down - F.when(cut_b, 1).otherwise(0)


def _run(first: Column, last: Column) -> Column:
    """The numbers of a closed interval; none if it is empty or an end has left the range of numbers."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def whole_cells(ranges: DataFrame, low: str, high: str, least: Column, most: Column, tier: str = "tier", cell: str = "cell") -> DataFrame:
    """``ranges`` with each row once for every cell of those that its numbers from ``least`` to ``most`` fall into, as few as can be.

    Ends are closed, NULL is open, and empty intervals have no cell.
    """
    taken = [*ranges.columns, tier, cell]
    a, b = _fresh(taken, "from_"), _fresh(taken, "to_")
    rows = ranges.withColumns(
        {
            a: F.greatest(F.coalesce(F.col(low).cast("long"), F.lit(LOWEST)), least),
            b: F.least(F.coalesce(F.col(high).cast("long"), F.lit(HIGHEST)), most),
        }
    ).where(F.col(a) <= F.col(b))
    length = F.col(b).cast("double") - F.col(a).cast("double") + 1
    # Rounding may only add a tier without cells.
    highest = F.least(F.lit(LAST), F.floor(F.log2(length) / STEP + F.lit(1e-9)).cast("int"))
    rows = rows.withColumn(tier, F.explode(F.sequence(F.lit(0), highest)))
    shift = (F.col(tier) * STEP).cast("int")
    first, last = _whole(F.col(a), F.col(b), shift)
    # On the last tier the shift of the tier above would be out of range.
    above_first, above_last = _whole(F.col(a), F.col(b), F.least(shift + STEP, F.lit(63)))
    inner_first = F.call_function("shiftleft", above_first, F.lit(STEP))
    # The last number of the cells inside; nothing follows the highest of all.
    inner_last = F.call_function("shiftleft", above_last, F.lit(STEP)).bitwiseOR(F.lit((1 << STEP) - 1).cast("long"))
    ends = F.concat(_run(first, F.try_subtract(inner_first, F.lit(1))), _run(F.try_add(inner_last, F.lit(1)), last))
    cells = F.when((F.col(tier) < LAST) & (above_first <= above_last), ends).otherwise(_run(first, last))
    return rows.withColumn(cell, F.explode(cells)).drop(a, b)


def interval_join(
    df: DataFrame,
    value: str,
    ranges: DataFrame,
    low: str,
    high: str,
    count: str | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of ``df`` with each row of ``ranges`` whose closed interval holds ``value`` (a whole number).

    A NULL end is open. Intervals may overlap and leave gaps; empty ones (low above high) and NULL values match nothing.
    The column names of both sides must differ.

    With ``count`` the matches come folded: the rows of ``ranges``, each once for every part of its interval that has matches, with
    their number as ``count`` and ``sums`` (``{name: column of df}``). These add up to the figures of all matches of the row, of
    which there may be as many as rows of ``df``; the parts are a few per tier.
    """
    if clash := set(df.columns) & set(ranges.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    if count is not None:
        return _folded_matches(df, value, ranges, low, high, count, dict(sums or {}))
    taken = [*df.columns, *ranges.columns]
    level, cell, levels, own_level, own_cell = (_fresh(taken, n) for n in ("level", "cell", "levels", "own_level", "own_cell"))
    parts = cells_of(ranges, low, high, level, cell)
    # A scalar subquery: the levels that occur.
    used = parts.agg(F.collect_set(level)).scalar()
    number = F.col(value).cast("long")
    rows = df.where(number.isNotNull()).withColumn(levels, used).withColumn(own_level, F.explode(levels))
    rows = rows.withColumn(own_cell, _cell(number, F.col(own_level)))
    above = F.coalesce(F.col(low).cast("long"), F.lit(LOWEST)) <= number
    below = number <= F.coalesce(F.col(high).cast("long"), F.lit(HIGHEST))
    same = (F.col(own_level) == F.col(level)) & (F.col(own_cell) == F.col(cell))
    return rows.join(parts, same & above & below).select(*df.columns, *ranges.columns)


def _bounds(numbers: DataFrame, name: str) -> tuple[Column, Column]:
    """Scalar subqueries: the smallest and the largest number."""
    return numbers.agg(F.min(name)).scalar(), numbers.agg(F.max(name)).scalar()


def _upper_tiers(cells: DataFrame, tier: str) -> Column:
    """Scalar subquery: the tiers above the fine ones that occur."""
    return cells.where(F.col(tier) >= FINE).agg(F.collect_set(tier)).scalar()


def _in_tier(block: str, tier: str) -> Column:
    """The cell on a tier above the fine ones that a block lies in."""
    return _shifted(F.col(block), (F.col(tier) - FINE) * STEP)


def _folded_matches(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, count: str, sums: dict[str, str]) -> DataFrame:
    if repeated := ({count, *sums} & set(ranges.columns)) or {count} & set(sums):
        raise ValueError(f"names of totals are taken: {sorted(repeated)}")
    taken = [*df.columns, *ranges.columns, count, *sums]
    number, tier, cell, own_tier, own_cell = (_fresh(taken, n) for n in ("number", "tier", "cell", "own_tier", "own_cell"))
    values = df.select(F.col(value).cast("long").alias(number), *(F.col(c).alias(n) for n, c in sums.items()))
    values = values.where(F.col(number).isNotNull())
    parts = whole_cells(ranges, low, high, *_bounds(values, number), tier, cell)

    def folded(rows: DataFrame, counted: Column, *keys: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(counted.alias(count), *(F.sum(n).alias(n) for n in sums))

    ones, again = F.count(F.lit(1)), F.sum(count)
    fine = values.withColumn(own_tier, F.explode(F.array(*map(F.lit, range(FINE)))))
    fine = folded(fine, ones, F.col(own_tier), _shifted(F.col(number), F.col(own_tier) * STEP).alias(own_cell))
    blocks = folded(values, ones, _shifted(F.col(number), FINE * STEP).alias(number))
    upper = blocks.withColumn(own_tier, F.explode(_upper_tiers(parts, tier)))
    upper = folded(upper, again, F.col(own_tier), _in_tier(number, own_tier).alias(own_cell))
    same = (F.col(own_tier) == F.col(tier)) & (F.col(own_cell) == F.col(cell))
    return fine.unionByName(upper).join(parts, same).select(*ranges.columns, count, *sums)


def range_bucket_from_table(
    df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str, order: str, name: str, default=None
) -> DataFrame:
    """``df`` with the label of the interval that holds ``value``; of several the one that is first by ``order``, then by label.

    Each distinct value is looked up once, however often it occurs, and meets one row per tier: the first of all
    intervals that hold the cell. Gaps and NULL get ``default``. Column names of ``ranges`` are free.
    """
    names = ("looked_up", "low_end", "high_end", "tag", "rank", "tier", "cell", "block", "own_tier", "own_cell", "best")
    key, a, b, tag, rank, tier, cell, block, own_tier, own_cell, best = (_fresh(df.columns, n) for n in names)
    table = ranges.select(F.col(low).alias(a), F.col(high).alias(b), F.col(label).alias(tag), F.col(order).alias(rank))
    numbers = df.select(F.col(value).cast("long").alias(key)).where(F.col(key).isNotNull())
    parts = whole_cells(table, a, b, *_bounds(numbers, key), tier, cell)
    first = F.min(F.struct(rank, tag))
    blocks = numbers.select(_shifted(F.col(key), FINE * STEP).alias(block)).distinct()
    upper = parts.where(F.col(tier) >= FINE).groupBy(tier, cell).agg(first.alias(best))
    rows = blocks.withColumn(own_tier, F.explode(_upper_tiers(parts, tier))).withColumn(own_cell, _in_tier(block, own_tier))
    same = (F.col(own_tier) == F.col(tier)) & (F.col(own_cell) == F.col(cell))
    upper = rows.join(upper, same).groupBy(block).agg(F.min(best).alias(f"{best}{FINE}"))
    found = numbers.distinct()
    for t in range(FINE):
        own = parts.where(F.col(tier) == t).groupBy(F.col(cell).alias(f"{cell}{t}")).agg(first.alias(f"{best}{t}"))
        found = found.join(own, _shifted(F.col(key), t * STEP) == F.col(f"{cell}{t}"), "left").drop(f"{cell}{t}")
    found = found.join(upper, _shifted(F.col(key), FINE * STEP) == F.col(block), "left")
    found = found.select(key, F.least(*[F.col(f"{best}{t}") for t in range(FINE + 1)]).alias(best))
    found = found.where(F.col(best).isNotNull()).select(key, F.col(f"{best}.{tag}").alias(tag))
    kept = [c for c in df.columns if c != name]
    labelled = F.when(F.col(key).isNull(), F.lit(default)).otherwise(F.col(tag))
    return df.join(found, F.col(value).cast("long") == F.col(key), "left").select(*kept, labelled.alias(name))
