"""Row-level derived columns: keys, buckets, timestamps, sentinels and flags.

Flags are integers 0/1, never booleans, because they are summed, cross-tabulated
and assembled into feature vectors further on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "#NULO#"

DATE_TIME = "dd/MM/yyyy HH:mm:ss"
DATE_MINUTE = "dd/MM/yyyy HH:mm"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def composite_key(*parts: Column | str, sep: str = "-") -> Column:
    """Join the parts to one text key. NULL parts are skipped, as ``concat_ws`` does."""
    return F.concat_ws(sep, *[_col(p) for p in parts])


def range_bucket(value: Column | str, ranges: Sequence[tuple], default) -> Column:
    """Label by closed ranges ``(low, high, label)``; gaps and NULL get ``default``."""
    value = _col(value)
    chain = F
    for low, high, label in ranges:
        chain = chain.when(value.between(low, high), F.lit(label))
    return chain.otherwise(F.lit(default)) if ranges else F.lit(default)


def member_bucket(value: Column | str, groups: Mapping[str, Iterable], default) -> Column:
    """Label by membership in value lists; anything else, NULL too, gets ``default``."""
    value = _col(value)
    chain = F
    for label, members in groups.items():
        chain = chain.when(value.isin(list(members)), F.lit(label))
    return chain.otherwise(F.lit(default)) if groups else F.lit(default)


def parse_timestamp(text: Column | str, fmt: str = DATE_TIME, sentinel: str = SENTINEL) -> Column:
    """Wall-clock timestamp from text; text that does not parse gives NULL, never an error.

    The sentinel is taken out first: it is common, and a failed parse costs
    several times what a successful one does.
    """
    return F.try_to_timestamp(F.nullif(_col(text), F.lit(sentinel)), F.lit(fmt)).cast("timestamp_ntz")


def parse_date_time(
    date: Column | str, time: Column | str, fmt: str = DATE_TIME, skip_nulls: bool = False, sentinel: str = SENTINEL
) -> Column:
    """Timestamp from a date text and a time text; NULL parts and sentinels are absent.

    By default an absent part makes the whole NULL. With ``skip_nulls`` the part
    that is there is parsed alone, which gives NULL too unless ``fmt`` fits it.
    """
    parts = [F.nullif(_col(p), F.lit(sentinel)) for p in (date, time)]
    joined = F.concat_ws(" ", *parts) if skip_nulls else F.concat(parts[0], F.lit(" "), parts[1])
    return parse_timestamp(joined, fmt, sentinel)


def sentinel_flag(value: Column | str, sentinel: str = SENTINEL, unmatched: str = "one") -> Column:
    """0 where the sentinel stands, 1 otherwise.

    A NULL (a row that found no partner in a left join) counts as 1 by default;
    ``unmatched="null"`` keeps it NULL.
    """
    if unmatched not in ("one", "null"):
        raise ValueError("unmatched must be 'one' or 'null'")
    value = _col(value)
    flag = F.when(value == sentinel, 0)
    if unmatched == "null":
        return flag.when(value.isNotNull(), 1)
    return flag.otherwise(1)


def sentinel_to_null(value: Column | str, sentinel: str = SENTINEL) -> Column:
    return F.nullif(_col(value), F.lit(sentinel))


def list_item_count(value: Column | str, sep: str = " / ", sentinel: str = SENTINEL) -> Column:
    """Number of items of a separated list; 0 for the sentinel and for NULL."""
    value = _col(value)
    literal_sep = "\\Q" + sep + "\\E"
    return F.when(value != sentinel, F.size(F.split(value, literal_sep))).otherwise(0)


def code_decode(value: Column | str, mapping: Mapping) -> Column:
    """Map codes to values; a code outside the mapping gives NULL."""
    value = _col(value)
    chain = F
    for code, decoded in mapping.items():
        chain = chain.when(value == code, F.lit(decoded))
    return chain if mapping else F.lit(None)


def equals_flag(value: Column | str, target) -> Column:
    return F.when(_col(value) == target, 1).otherwise(0)


def null_to(value: Column | str, default) -> Column:
    return F.coalesce(_col(value), F.lit(default))


def present_flag(value: Column | str) -> Column:
    return _col(value).isNotNull().cast("int")


def floor_positive(value: Column | str, floor: float = 0.001) -> Column:
    """The value where it is positive, else ``floor``; NULL and negatives get ``floor`` too."""
    value = _col(value)
    return F.when(value > 0, value).otherwise(F.lit(floor))


def before_cutoff_flag(ts: Column | str, cutoff: str) -> Column:
    """1 strictly before the cut-off, 0 at it, after it and for NULL."""
    return F.when(_col(ts) < F.lit(cutoff).cast("timestamp_ntz"), 1).otherwise(0)


def elapsed_seconds(later: Column | str, earlier: Column | str) -> Column:
    """Signed whole seconds ``later - earlier``."""
    return F.unix_timestamp(_col(later)) - F.unix_timestamp(_col(earlier))
