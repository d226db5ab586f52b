"""Row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = 8


def hash_keep(keys: Sequence[str], fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of the keys, decided by a hash of key and seed alone."""
    digest = F.md5(F.concat_ws("-", *keys, F.lit(str(seed))))
    return F.substring(digest, 1, _DIGITS) < F.lit(f"{int(fraction * 16**_DIGITS):0{_DIGITS}x}")


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Sample that does not depend on how the data is partitioned; rows with equal keys stay together."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return df if fraction == 1.0 else df.where(hash_keep(keys, fraction, seed))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sampler: cheaper per row, but the rows kept depend on the partitioning."""
    return df if fraction == 1.0 else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_projection(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    where: Column | None = None,
    fraction: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Filtered, sampled and narrowed to the plotted columns."""
    if where is not None:
        df = df.where(where)
    return hash_sample(df, keys, fraction, seed).select(*columns)
