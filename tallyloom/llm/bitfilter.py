"""Filters of a fixed number of bits: built by tasks, united by Spark, and asked by tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of one of Spark's bitmaps.
_BITMAP = 32768


def bits_for(count: int, least: int) -> int:
    """Bits of a filter of ``count`` numbers of which one in sixteen or less is set: ``least`` or more, up to 2 ** 27 (16 MB)."""
    return min(max(least, 1 << (16 * count).bit_length()), max(least, 1 << 27))


def of(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for every number of ``column`` modulo ``bits`` (a multiple of 32,768): ``bits / 8`` bytes reach the driver."""
    bit = F.pmod(F.col(column), F.lit(bits))
    parts = rows.select(F.floor(bit / _BITMAP).alias("part"), (bit % _BITMAP).alias("bit"))
    found = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    out = np.zeros((bits // _BITMAP, _BITMAP // 8), dtype=np.uint8)
    for r in found:
        out[r["part"]] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out.ravel()


def passes(packed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each of the 64-bit ``numbers`` has its bit."""
    at = numbers.view(np.uint64) & np.uint64(8 * len(packed) - 1)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
