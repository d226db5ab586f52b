"""Equi-joins with an explicit policy for duplicate keys.

No side of a join carries a broadcast hint: Catalyst broadcasts a side whose size
statistics are under ``spark.sql.autoBroadcastJoinThreshold``, AQE does it for a
side whose *measured* shuffle output is, and above that both sides are shuffled
and AQE splits the partitions a hot key makes too big. The one hint is on the
list of hot right keys of a left join, which a count bounds.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FanoutError(ValueError):
    """A side that must have one row per key has several."""


def fanout_audit(df: DataFrame, keys: Sequence[str], count_name: str = "n_rows") -> DataFrame:
    """Keys with more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name)).where(F.col(count_name) > 1)


def first_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One whole input row per key: the smallest by its remaining columns, in order.

    An aggregate, not a window: copies of a hot key are folded before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def unique_side(df: DataFrame, keys: Sequence[str], policy: str = "error") -> DataFrame:
    """Apply a duplicate-key policy to a join side.

    ``error`` runs one aggregate over the keys and raises on a duplicate,
    ``dedupe`` keeps one row per key, ``allow`` leaves the fan-out.
    """
    if policy == "allow":
        return df
    if policy == "dedupe":
        return first_row_per_key(df, keys)
    if policy != "error":
        raise ValueError("policy must be 'error', 'dedupe' or 'allow'")
    if not fanout_audit(df.select(*keys), keys).isEmpty():
        raise FanoutError(f"several rows for one value of {list(keys)}")
    return df


def join_inner(left: DataFrame, right: DataFrame, on: Sequence[str], duplicates: str = "allow") -> DataFrame:
    return left.join(unique_side(right, on, duplicates), list(on), "inner")


# A right key with more rows than this is split. At most one key in so many right
# rows can be hot, so the list of hot keys that is broadcast is as much smaller.
HOT_ROWS = 1_000_000


def _free(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _spread(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], hot_rows: int
) -> tuple[DataFrame, DataFrame, str, str, str]:
    """Both sides with a share number that splits the hot keys of the right side.

    A key with n right rows has ceil(n / hot_rows) shares: its right rows are
    dealt to them by their content, so that equal rows stay together, and its left
    rows copied to all. Other keys have share 0 only.
    Returns the sides and the names of the share, of the left column that tells
    a copied row, and of the right column that tells a partner.
    """
    if hot_rows < 1:
        raise ValueError("hot_rows must be 1 or more")
    share, copied, here, shares = (_free(n, left, right) for n in ("_share", "_copied", "_here", "_shares"))
    keys = [f"{share}_{i}" for i in range(len(right_on))]
    counted = right.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(right_on, keys)]).agg(F.count(F.lit(1)).alias(shares))
    hot = F.broadcast(
        counted.where(F.col(shares) > hot_rows).withColumn(shares, F.ceil(F.col(shares) / hot_rows).cast("int"))
    )

    def marked(df: DataFrame, on: Sequence[str]) -> DataFrame:
        same = reduce(and_, [F.col(f"`{c}`") == F.col(k) for c, k in zip(on, keys)])
        return df.join(hot, same, "left").drop(*keys)

    last = F.coalesce(F.col(shares), F.lit(1)) - 1
    lefts = marked(left, left_on).select(
        *[F.col(f"`{c}`") for c in left.columns],
        F.col(shares).isNotNull().alias(copied),
        F.explode(F.sequence(F.lit(0), last)).alias(share),
    )
    # By content, not by place or at random: a task that runs again deals alike, whatever order its rows come in.
    content = [F.col(f"`{f.name}`") for f in right.schema.fields if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]
    dealt = F.pmod(F.xxhash64(*content), F.coalesce(F.col(shares), F.lit(1)).cast("bigint")).cast("int")
    rights = marked(right, right_on).select(
        *[F.col(f"`{c}`") for c in right.columns], F.lit(True).alias(here), dealt.alias(share)
    )
    return lefts, rights, share, copied, here


def join_left(
    left: DataFrame, right: DataFrame, on: Sequence[str], duplicates: str = "allow", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left outer join that survives a hot key on either side.

    AQE splits the left side of a left outer join but never the right one. Where
    the right side may repeat a key, its rows are counted by key first (from the
    key columns only); keys with more than ``hot_rows`` rows are split in shares,
    all others are joined plainly, in the same one join. A hot key has partners
    by its nature, so a copied left row without a partner in its share is
    dropped. The left rows are read once.
    """
    right = unique_side(right, on, duplicates)
    if duplicates != "allow":
        return left.join(right, list(on), "left")
    lefts, rights, share, copied, here = _spread(left, right, on, on, hot_rows)
    joined = lefts.join(rights, [*on, share], "left").where(~F.col(copied) | F.col(here).isNotNull())
    return joined.drop(share, copied, here)


def enrich_detail(
    base: DataFrame,
    match: DataFrame,
    match_on: Sequence[str],
    extra: DataFrame,
    extra_on: Sequence[str],
    match_columns: Mapping[str, Column | str] | None = None,
    extra_columns: Mapping[str, Column | str] | None = None,
    duplicates: str = "allow",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``base`` inner-joined to ``match`` and left-joined to ``extra``, at the grain of ``base``.

    The added columns are ``{new name: source}``. Sources are evaluated after
    the join, so an expression sees NULL where ``extra`` has no partner.
    """
    match_columns = dict(match_columns or {})
    extra_columns = dict(extra_columns or {})
    b, m, x = base.alias("base"), match.alias("match"), extra.alias("extra")
    if duplicates != "allow":
        m = unique_side(match, match_on, duplicates).alias("match")
        x = unique_side(extra, extra_on, duplicates).alias("extra")
    on_match = [F.col(f"base.{k}") == F.col(f"match.{k}") for k in match_on]
    on_extra = [F.col(f"base.{k}") == F.col(f"extra.{k}") for k in extra_on]

    def added(columns: Mapping[str, Column | str], side: str) -> list[Column]:
        return [
            (F.col(f"{side}.{src}") if isinstance(src, str) else src).alias(new)
            for new, src in columns.items()
        ]

    columns = [*added(match_columns, "match"), *added(extra_columns, "extra")]
    matched = b.join(m, on_match, "inner")
    if duplicates != "allow":
        return matched.join(x, on_extra, "left").select("base.*", *columns)
    # As in join_left: the extra side may have a hot key.
    lefts, rights, share, copied, here = _spread(base, extra, extra_on, extra_on, hot_rows)
    matched = lefts.alias("base").join(m, on_match, "inner")
    on_extra.append(F.col(f"base.{share}") == F.col(f"extra.{share}"))
    joined = matched.join(rights.alias("extra"), on_extra, "left")
    kept = joined.where(~F.col(f"base.{copied}") | F.col(f"extra.{here}").isNotNull())
    return kept.select(*[F.col(f"base.`{c}`") for c in base.columns], *columns)


def left_join_default(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    defaults: Mapping[str, object],
    present: Mapping[str, str] | None = None,
) -> DataFrame:
    """Left join to a side with one row per key, with defaults instead of NULL.

    ``defaults`` is ``{right column: value where absent}``; ``present`` adds 0/1
    columns ``{new name: right column}`` that say whether the right value exists.
    """
    joined = left.join(right.select(*on, *defaults), list(on), "left")
    flags = {new: F.col(c).isNotNull().cast("int") for new, c in (present or {}).items()}
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return joined.select(
        *left.columns,
        *[expr.alias(c) for c, expr in filled.items()],
        *[expr.alias(c) for c, expr in flags.items()],
    )
