"""Equity of ordered results without a whole path in one task.

A piece of a path is summed up by four numbers: its total, its greatest and least running sum, and its greatest fall
from a running maximum. Two pieces in a row give the four numbers of both, so pieces are folded in any grouping: rows meet
one shuffle by (key, chunk), and everything else works on one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunks import chunk_of


def path(df: DataFrame, value: Column, by: Sequence[str] = ("symbol",), rows: int | None = None, sum_name: str = "cum", top_name: str = "top") -> DataFrame:
    """Running sum of `value` and its greatest value so far, for numbered rows.

    Both are windows over one chunk; the chunk's own start and the highest point before it come from chunk totals.
    """
    by = list(by)
    frame = Window.partitionBy(*by, "chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("chunk", chunk_of(rows)).withColumn("__v", value).withColumn("__sum", F.sum("__v").over(frame)).withColumn("__top", F.max("__sum").over(frame))
    ends = local.groupBy(*by, "chunk").agg(F.sum("__v").alias("__total"), F.max("__sum").alias("__high"))
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__start", F.sum("__total").over(before))
    ends = ends.withColumn("__peak", F.max(F.coalesce(F.col("__start") + F.col("__high"), F.col("__high"))).over(before))
    own = lambda c: F.coalesce(F.col("__start") + F.col(c), F.col(c))
    keep = [c for c in df.columns if c not in (sum_name, top_name)]
    return local.join(ends.select(*by, "chunk", "__start", "__peak"), [*by, "chunk"]).select(*keep, own("__sum").alias(sum_name), F.greatest(own("__top"), F.col("__peak")).alias(top_name))


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def folded(df: DataFrame, value: Column, by: Sequence[str], chunk: Column, order: Sequence[str], also: Mapping[str, tuple[str, Column]] | None = None, from_start: bool = True) -> DataFrame:
    """Per key: `total`, `high` and `low` (greatest and least running sum), `fall` (greatest fall below an earlier high
    point; the start at 0 counts as one unless `from_start` is off), and the ``sum | max | min`` of further columns.

    `chunk` cuts a key into pieces of bounded size and never decreases along `order`. No window is over a whole key's
    rows, only over its chunks.
    """
    by, also = list(by), dict(also or {})
    frame = Window.partitionBy(*by, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("chunk", chunk).withColumn("__v", value).withColumn("__sum", F.sum("__v").over(frame)).withColumn("__top", F.max("__sum").over(frame))
    piece = local.groupBy(*by, "chunk").agg(
        F.sum("__v").alias("__total"), F.max("__sum").alias("__high"), F.min("__sum").alias("__low"), F.max(F.col("__top") - F.col("__sum")).alias("__fall"),
        *[_MERGE[kind](c).alias(f"__a_{n}") for n, (kind, c) in also.items()],
    )
    return folded_pieces(piece, by, {n: kind for n, (kind, _) in also.items()}, from_start)


def folded_pieces(piece: DataFrame, by: Sequence[str], also: Mapping[str, str] | None = None, from_start: bool = True) -> DataFrame:
    """The result of `folded` from one row per piece: `chunk`, `__total`, `__high`, `__low`, `__fall`, and `__a_<name>` for
    every further column and its ``sum | max | min``."""
    by, also = list(by), dict(also or {})
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("__start", F.coalesce(F.sum("__total").over(before), F.lit(0).cast("int")))
    zero = [F.lit(0).cast("int")] if from_start else []
    peak = F.max(F.col("__start") + F.col("__high")).over(before)
    piece = piece.withColumn("__peak", F.greatest(peak, *zero) if zero else peak)
    return piece.groupBy(*by).agg(
        F.sum("__total").alias("total"), F.max(F.col("__start") + F.col("__high")).alias("high"), F.min(F.col("__start") + F.col("__low")).alias("low"),
        F.max(F.greatest(F.col("__fall"), F.col("__peak") - F.col("__start") - F.col("__low"))).alias("fall"),
        *[_MERGE[kind](f"__a_{n}").alias(n) for n, kind in also.items()],
    )


def moments(d: Column, name: str) -> dict[str, tuple[str, Column]]:
    """Columns for `folded` from which `spread` takes mean and deviation of `d` (nulls are left out)."""
    d = d.cast("double")
    return {f"{name}_n": ("sum", F.when(d.isNotNull(), 1).otherwise(0)), f"{name}_s": ("sum", d), f"{name}_q": ("sum", d * d)}


def spread(name: str) -> tuple[Column, Column]:
    """Mean and population deviation."""
    n, s, q = (F.col(f"{name}_{k}") for k in "nsq")
    mean = F.when(n > 0, s / n)
    return mean, F.when(n > 0, F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0))))
