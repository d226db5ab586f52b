"""Column builders; every one is a built-in expression that stays in the JVM."""

from .derive import (
    before_cutoff_flag,
    code_decode,
    composite_key,
    elapsed_seconds,
    equals_flag,
    floor_positive,
    list_item_count,
    member_bucket,
    null_to,
    parse_date_time,
    parse_timestamp,
    present_flag,
    range_bucket,
    sentinel_flag,
    sentinel_to_null,
)
from .frames import cast_codes, drop_columns, filter_equal, floor_positive_columns, null_audit
from .late import LateRule, late_expr

__all__ = [
    "LateRule",
    "before_cutoff_flag",
    "cast_codes",
    "code_decode",
    "composite_key",
    "drop_columns",
    "elapsed_seconds",
    "equals_flag",
    "filter_equal",
    "floor_positive",
    "floor_positive_columns",
    "late_expr",
    "list_item_count",
    "member_bucket",
    "null_audit",
    "null_to",
    "parse_date_time",
    "parse_timestamp",
    "present_flag",
    "range_bucket",
    "sentinel_flag",
    "sentinel_to_null",
]
