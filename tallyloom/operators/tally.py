"""Fold detail rows to one wide row per key.

Everything here is an algebraic aggregate, so rows of a hot key are reduced in
the map tasks and at most one row per key and map task is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.late import LateRule, late_expr


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tally_columns(category: Column | str, measure: Column | str, names: Mapping) -> list[Column]:
    """One conditional sum per ``{category value: column name}``; 0 where a value is absent."""
    category, measure = _col(category), _col(measure)
    return [F.sum(F.when(category == v, measure).otherwise(0)).alias(n) for v, n in names.items()]


def row_pick(columns: Mapping[str, Column | str], alias: str) -> Column:
    """Aggregate that picks the values of one and the same row: the smallest, NULLs first."""
    return F.min(F.struct(*[_col(src).alias(new) for new, src in columns.items()])).alias(alias)


def label_mask(value: Column | str, domain: Sequence) -> Column:
    """One bit per label of a closed domain (63 at most); combine with ``bit_or``. NULL has no bit."""
    if len(domain) > 63:
        raise ValueError("a domain holds 63 labels at most")
    value = _col(value)
    stray = F.raise_error(F.concat(F.lit("value outside the domain: "), value.cast("string")))
    chain = F.when(value.isNull(), F.lit(0).cast("bigint"))
    for i, label in enumerate(sorted(domain)):
        chain = chain.when(value == label, F.lit(1 << i).cast("bigint"))
    return chain.otherwise(stray.cast("bigint"))


def mask_labels(mask: Column | str, domain: Sequence, sep: str = ",") -> Column:
    """The labels of a mask as sorted text."""
    mask = _col(mask)
    found = [
        F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(str(label)))
        for i, label in enumerate(sorted(domain))
    ]
    return F.array_join(F.array_compact(F.array(*found)), sep)


def distinct_list(value: Column | str, sep: str = ",", domain: Sequence | None = None) -> Column:
    """Aggregate: the distinct values as sorted text.

    With a closed ``domain`` (for example the labels of a bucket expression) the
    state is one integer instead of a set; a value outside the domain is an error.
    """
    if domain is not None:
        return mask_labels(F.bit_or(label_mask(value, domain)), domain, sep)
    return F.array_join(F.sort_array(F.collect_set(_col(value))).cast("array<string>"), sep)


def wide_tally(
    df: DataFrame,
    keys: Sequence[str],
    category: Column | str,
    measure: Column | str,
    names: Mapping,
    constants: Mapping[str, Column | str] | None = None,
    latest: Mapping[str, Column | str] | None = None,
    extra: Sequence[Column] = (),
    pick: str = "row",
) -> DataFrame:
    """One row per key: conditional sums, group constants and latest values.

    ``constants`` are columns that do not vary within a key; should one vary
    after all, ``pick="row"`` takes all of them from one row (the smallest) and
    ``pick="column"`` takes each column's minimum. The second form has
    fixed-width state when the columns do, and so needs no sort.
    """
    if pick not in ("row", "column"):
        raise ValueError("pick must be 'row' or 'column'")
    constants = dict(constants or {})
    aggs = tally_columns(category, measure, names)
    aggs += [F.max(_col(src)).alias(new) for new, src in (latest or {}).items()]
    aggs += list(extra)
    if not constants:
        return df.groupBy(*keys).agg(*aggs)
    if pick == "column":
        return df.groupBy(*keys).agg(*[F.min(_col(s)).alias(n) for n, s in constants.items()], *aggs)
    folded = df.groupBy(*keys).agg(row_pick(constants, "_first"), *aggs)
    others = [c for c in folded.columns if c not in (*keys, "_first")]
    return folded.select(*keys, "_first.*", *others)


def winner_flags(
    df: DataFrame, a: str, b: str, a_wins: str = "a_wins", b_wins: str = "b_wins", tie: str = "tie"
) -> DataFrame:
    """Which of two tallied columns is larger, as three 0/1 columns."""
    first, second = F.col(a), F.col(b)
    return df.withColumns(
        {
            a_wins: F.when(first > second, 1).otherwise(0),
            b_wins: F.when(first < second, 1).otherwise(0),
            tie: F.when(first == second, 1).otherwise(0),
        }
    )


def tally_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``name = numerator / denominator``; NULL where the denominator is 0."""
    return df.withColumns({n: F.try_divide(F.col(a), F.col(b)) for n, (a, b) in ratios.items()})


def late_flag(df: DataFrame, keys: Sequence[str], ts: str, rules: Sequence[LateRule], name: str = "late") -> DataFrame:
    """1 for a key with any late row."""
    return df.groupBy(*keys).agg(F.max(late_expr(ts, rules)).alias(name))


def late_flag_from_table(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    area: str,
    cutoffs: DataFrame,
    exception: str | None = None,
    name: str = "late",
) -> DataFrame:
    """As ``late_flag``, with cut-offs in a table ``(area, exception, cutoff_ts)``.

    A cut-off row with an ``exception`` value overrides the area's own (the row
    whose ``exception`` is NULL); at most one row each. Areas without a cut-off
    give 0. A cut-off table of lookup size is broadcast by its statistics, and
    the only shuffle is then the fold by key.
    """
    general = cutoffs.where(F.col("exception").isNull()).select(
        F.col("area").alias(area), F.col("cutoff_ts").alias("_general")
    )
    rows = df.select(*dict.fromkeys([*keys, ts, area, *([exception] if exception else [])])).join(general, area, "left")
    cutoff = F.col("_general")
    if exception:
        special = cutoffs.where(F.col("exception").isNotNull()).select(
            F.col("exception").alias(exception), F.col("cutoff_ts").alias("_special")
        )
        rows = rows.join(special, exception, "left")
        cutoff = F.coalesce(F.col("_special"), cutoff)
    return rows.groupBy(*keys).agg(F.max(F.when(F.col(ts) > cutoff, 1).otherwise(0)).alias(name))


def sum_by_category(df: DataFrame, category: str, measure: Column | str, name: str = "total") -> DataFrame:
    return df.groupBy(category).agg(F.sum(_col(measure)).alias(name))


def conditional_sum_by_key(
    df: DataFrame,
    key: Mapping[str, Column],
    measure: Column | str,
    sums: Mapping[str, Column],
    where: Column | None = None,
) -> DataFrame:
    """Conditional sums by computed keys: ``key`` is ``{name: expression}``, ``sums`` ``{name: condition}``."""
    if where is not None:
        df = df.where(where)
    measure = _col(measure)
    return df.groupBy(*[expr.alias(name) for name, expr in key.items()]).agg(
        *[F.sum(F.when(cond, measure).otherwise(0)).alias(name) for name, cond in sums.items()]
    )
