"""Reading delimited text and stored stages, writing results."""

from .delimited import checked_lines, quarantine, read_delimited, rejects_by_column
from .sinks import write_delimited, write_parquet, write_partitioned, write_sorted
from .stages import StageStore, register, shared_root

__all__ = [
    "StageStore",
    "checked_lines",
    "quarantine",
    "read_delimited",
    "register",
    "rejects_by_column",
    "shared_root",
    "write_delimited",
    "write_parquet",
    "write_partitioned",
    "write_sorted",
]
