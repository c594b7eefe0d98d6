"""Exact ranks and quantiles of groups too large for one task.

A group's distinct values are cut into `CUTS` value ranges at approximate quantiles (a bounded sketch per group);
every range is sorted on its own and the ranges are joined by offsets. Ties are collapsed first, so a value that
holds most rows is one entry with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def rank_table(df: DataFrame, by: Sequence[str], value: str, cuts: int = CUTS) -> DataFrame:
    """Distinct values with `n` (ties), `below` (rows strictly smaller) and `total` rows of the group."""
    by = list(by)
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    probs = [(i + 1) / cuts for i in range(cuts - 1)]
    edges = v.groupBy(*by).agg(F.percentile_approx(value, probs, 20 * cuts).alias("__edges"))
    key = F.size(F.filter("__edges", lambda e: e <= F.col(value)))
    cut = (v.join(edges, by) if by else v.crossJoin(edges)).withColumn("__range", key).drop("__edges")
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sizes = cut.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))  # at most `cuts` rows per group
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"), F.sum("__n").over(Window.partitionBy(*by)).alias("total")
    )
    return local.join(offsets, by + ["__range"]).select(*by, value, "n", (F.col("__below") + F.col("__off")).alias("below"), "total")


def average_rank() -> Column:
    return F.col("below") + (F.col("n") + 1) / 2.0


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles (numpy's default), one column per entry of `probs`, plus `n_rows`."""
    t = rank_table(df, by, value)
    picks, outs = [], []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}_{name}"))
        frac = F.lit(float(q)) * (F.col("n_rows") - 1) - F.floor(F.lit(float(q)) * (F.col("n_rows") - 1))
        outs.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * frac).alias(name))
    g = t.groupBy(*by) if by else t.groupBy()
    return g.agg(*picks, F.max("total").alias("n_rows")).select(*by, "n_rows", *outs)


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the average rank of `value` inside their group (null values get no rank). Spark's adaptive skew join
    splits the probe side where one value is very frequent."""
    ranks = rank_table(df, by, value).select(*by, value, average_rank().alias(name))
    return df.join(ranks, [*by, value], "left")
