"""Seeded ordering and sampling that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY_DIGITS = 15  # hexadecimal digits compared against the threshold: 60 bits


def hash_key(id_col: str | Column, seed: int) -> Column:
    """A pseudo-random hexadecimal key per id: the same on every run and partitioning."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", col.cast("string"), F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Rows in a seeded random order (a range-partitioned sort, not one task)."""
    return df.orderBy(hash_key(id_col, seed), F.col(id_col))


def hash_sample(
    df: DataFrame, size: int, seed: int, id_col: str = "id", n_rows: int | None = None
) -> DataFrame:
    """Exactly ``min(size, n)`` rows without replacement: those with the smallest hash keys.

    A threshold on the key first cuts the table to slightly more than ``size`` rows, so the
    final top-k sees a few thousand rows however many partitions the table has. The
    threshold is checked, and widened if it let through too few, so the result is exact.
    """
    if size < 1:
        raise ValueError("sample size must be positive")
    n = df.count() if n_rows is None else n_rows
    if n <= size:
        return df
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    share = (size + 6.0 * math.sqrt(size) + 10.0) / n
    while share < 1.0:
        bound = format(int(share * 16**_KEY_DIGITS), f"0{_KEY_DIGITS}x")
        near = keyed.filter(F.col("_key") < F.lit(bound))
        if near.count() >= size:
            keyed = near
            break
        share *= 2.0
    return keyed.orderBy("_key", id_col).limit(size).drop("_key")
