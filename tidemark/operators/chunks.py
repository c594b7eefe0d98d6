"""Ordered computations that never need a whole key in one task.

A symbol may hold a third of all rows, so ``Window.partitionBy("symbol")`` is not an option for row-level data.
Every ordered operator of this package rests on four steps:

* ``index_rows``  numbers the rows of a key 1..n; only one bucket of a key is ever sorted in one task, and bucket
  counts are turned into offsets on a small table.
* ``rolling``     evaluates bounded row frames on equal-sized row chunks; each chunk also receives the few
  neighbouring rows its frames reach into.
* ``running``     evaluates cumulative frames: local value per chunk, plus a carry-in from a per-chunk summary.
* ``affine_scan`` evaluates ``y[t] = a[t] * y[t-1] + b[t]``; affine maps compose, so a chunk is summarised by one
  (A, B) pair and the carry-in is a fold over those pairs.

Chunks hold ``CHUNK_ROWS`` consecutive rows of a key whatever the distribution of keys or timestamps, so a hot
symbol simply becomes many chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 65_536


def _rows(rows: int | None) -> int:
    return CHUNK_ROWS if rows is None else rows


def index_rows(
    df: DataFrame,
    by: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column | str],
    name: str = "rn",
) -> DataFrame:
    """Add the 1-based position of each row within its `by` key.

    `buckets` are expressions that never decrease along `order`, coarse first. Give a second, finer one where a
    single coarse bucket has no size bound.
    """
    by = list(by)
    bs = [f"__bucket{i}" for i in range(len(buckets))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(buckets, bs)])
    local = keyed.withColumn("__local", F.row_number().over(Window.partitionBy(*by, *bs).orderBy(*order)))
    # Every level is derived from the same counts, so the source is read once for the rows and once for the counts.
    counts = keyed.groupBy(*by, *bs).agg(F.count(F.lit(1)).alias("__n"))
    earlier = lambda level: Window.partitionBy(*by, *bs[:level]).orderBy(bs[level]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda level: F.coalesce(F.sum("__n").over(earlier(level)), F.lit(0))
    last = len(bs) - 1
    offsets = counts.select(*by, *bs, before(last).alias("__off"))
    for level in range(last):
        keys = by + bs[: level + 1]
        coarse = counts.groupBy(*keys).agg(F.sum("__n").alias("__n")).select(*keys, before(level).alias("__more"))
        offsets = offsets.join(coarse, keys).select(*by, *bs, (F.col("__off") + F.col("__more")).alias("__off"))
    return local.join(offsets, by + bs).withColumn(name, F.col("__local") + F.col("__off")).drop("__local", "__off", *bs)


def chunk_of(rows: int | None = None, shift: int = 0) -> Column:
    return F.floor((F.col("rn") - 1 + shift) / _rows(rows)).cast("long")


def rolling(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    by: Sequence[str] = ("symbol",),
    rows: int | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Apply `build(df, window)` where no frame reaches further than `back` rows behind or `ahead` rows in front.

    ``keep_chunk`` leaves the chunk column in place, so that a scan can follow on the same partitioning.
    """
    spread = F.explode(F.sequence(F.greatest(chunk_of(rows, -ahead), F.lit(0)), chunk_of(rows, back)))
    copies = df.withColumn("__own", chunk_of(rows)).withColumn("chunk", spread)
    out = build(copies, Window.partitionBy(*by, "chunk").orderBy("rn"))
    out = out.where(F.col("chunk") == F.col("__own")).drop("__own")
    return out if keep_chunk else out.drop("chunk")


_COMBINE = {
    "sum": (F.sum, lambda carry, own: F.coalesce(carry + own, own, carry)),
    "max": (F.max, lambda carry, own: F.greatest(carry, own)),
    "min": (F.min, lambda carry, own: F.least(carry, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, own: F.coalesce(own, carry)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda carry, own: F.coalesce(carry, own)),
}


def running(
    df: DataFrame,
    columns: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = ("symbol",),
    rows: int | None = None,
    until: int = 0,
) -> DataFrame:
    """Cumulative ``sum | max | min | last | first`` from the first row of a key up to the current one.

    ``until=-1`` stops at the previous row.
    """
    by = list(by)
    base = df.withColumn("chunk", chunk_of(rows)).select("*", *[v.alias(f"__v_{n}") for n, (_, v) in columns.items()])
    frame = Window.partitionBy(*by, "chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, until)
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carry, joined = [], [], [], []
    for n, (kind, _) in columns.items():
        fold, combine = _COMBINE[kind]
        value = F.col(f"__v_{n}")
        local.append(fold(value).over(frame).alias(f"__l_{n}"))
        pick = F.when(value.isNotNull(), F.col("rn"))
        whole = F.max_by(value, pick) if kind == "last" else F.min_by(value, pick) if kind == "first" else fold(value)
        summary.append(whole.alias(f"__s_{n}"))
        carry.append(fold(F.col(f"__s_{n}")).over(before).alias(f"__c_{n}"))
        joined.append(combine(F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n))
    totals = base.groupBy(*by, "chunk").agg(*summary).select(*by, "chunk", *carry)
    keep = [c for c in df.columns if c not in columns]
    return base.select("*", *local).join(totals, by + ["chunk"]).select(*keep, *joined)


def compose_prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix composition of the maps y -> a*y + b along the first axis (log-step doubling).

    ``a == 0`` forgets the past, also where the past is NaN.
    """
    a, b = a.copy(), b.copy()
    step = 1
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        while step < len(a):
            head_a, head_b = a[:-step].copy(), b[:-step].copy()
            tail = a[step:]
            b[step:] = np.where(tail == 0, b[step:], tail * head_b + b[step:])
            a[step:] = np.where(tail == 0, 0.0, tail * head_a)
            step *= 2
    return a, b


def affine_scan(
    df: DataFrame,
    scans: Mapping[str, tuple[Column, Column]],
    by: Sequence[str] = ("symbol",),
    rows: int | None = None,
) -> DataFrame:
    """Add ``y[t] = a[t] * y[t-1] + b[t]`` for every ``name: (a, b)``.

    A row with ``a = 0`` (re)starts the recursion at ``b``; ``b = null`` there keeps the output null until a later
    seed row. A `chunk` column left by ``rolling(keep_chunk=True)`` is used as it is, which saves a shuffle.
    """
    by = list(by)
    names = list(scans)
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    terms = []
    for n, (a, b) in scans.items():
        known = a.isNotNull() & b.isNotNull()
        terms.append(F.when(known, a.cast("double")).otherwise(zero).alias(f"__a_{n}"))
        terms.append(F.when(known, b.cast("double")).otherwise(nothing).alias(f"__b_{n}"))
    chunked = df if "chunk" in df.columns else df.withColumn("chunk", chunk_of(rows))
    base = chunked.select("*", *terms, F.lit(False).alias("__last"))
    a_cols, b_cols = [f"__a_{n}" for n in names], [f"__b_{n}" for n in names]

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        stack = lambda cols: np.column_stack([table[c].to_numpy(zero_copy_only=False) for c in cols]).astype(float)
        a, b = compose_prefix(stack(a_cols), stack(b_cols))
        for cols, m in ((a_cols, a), (b_cols, b)):
            for j, c in enumerate(cols):
                at = table.schema.get_field_index(c)
                table = table.set_column(at, pa.field(c, pa.float64()), pa.array(m[:, j]))
        last = np.zeros(len(a), dtype=bool)
        last[-1:] = True
        return table.set_column(table.schema.get_field_index("__last"), "__last", pa.array(last))

    maps = base.groupBy(*by, "chunk").applyInArrow(local, base.schema)
    ends = maps.where("__last").select(*by, "chunk", *a_cols, *b_cols)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        stack = lambda cols: np.column_stack([table[c].to_numpy(zero_copy_only=False) for c in cols]).astype(float)
        _, b = compose_prefix(stack(a_cols), stack(b_cols))
        carried = np.vstack([np.full((1, len(names)), np.nan), b[:-1]])
        keys = [table[k] for k in by] + [table["chunk"]]
        return pa.table(keys + [pa.array(carried[:, j]) for j in range(len(names))], names=by + ["chunk"] + carry_cols)

    carry_cols = [f"__c_{n}" for n in names]
    carry_schema = T.StructType(
        [df.schema[k] for k in by]
        + [T.StructField("chunk", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in carry_cols]
    )
    # One row per chunk of a key: n / CHUNK_ROWS rows, folded per key.
    carry = ends.groupBy(*by).applyInArrow(fold, carry_schema)
    results = []
    for n in names:
        y = F.when(F.col(f"__a_{n}") == 0, F.col(f"__b_{n}")).otherwise(
            F.col(f"__a_{n}") * F.col(f"__c_{n}") + F.col(f"__b_{n}")
        )
        results.append(F.when(~F.isnan(y), y).alias(n))
    keep = [c for c in df.columns if c not in names and c != "chunk"]
    return maps.join(carry, by + ["chunk"]).select(*keep, *results)
