"""Sorts, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Best `n` rows: Spark keeps n rows per partition and merges them."""
    return df.orderBy(*order).limit(n)


def top_k_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, salts: int = 16) -> DataFrame:
    """First `k` rows per key with their rank.

    A first ranking inside salted sub-groups keeps at most k rows of each, so a hot key never meets in one task.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = df.withColumn("__salt", salt)
    inner = Window.partitionBy(*by, "__salt").orderBy(*order)
    few = part.withColumn("__k", F.row_number().over(inner)).where(F.col("__k") <= k).drop("__salt", "__k")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The newest `n` rows per key (`order` newest first)."""
    return top_k_per(df, by, order, n)


def remaining(all_keys: DataFrame, done: DataFrame) -> DataFrame:
    return all_keys.subtract(done)


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
