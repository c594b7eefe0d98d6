"""Ticks to bars, bars to coarser bars, and order-flow aggregates. All are partial aggregations on (symbol, bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY
from tidemark.functions.times import floor_time, second_of_day
from tidemark.operators.chunks import index_rows, rolling
from tidemark.session import settle


def arrival_key(time: str = "time", tiebreak: str = "event_id") -> Column:
    """(time, id) packed into one fixed-width decimal, so min_by / max_by stay in the hash aggregation."""
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(19,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)") + F.col(tiebreak).cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, width: str) -> DataFrame:
    """First / max / min / last / count of each bucket that has ticks."""
    keyed = ticks.withColumn("bucket", floor_time("time", width)).withColumn("__k", arrival_key())
    return keyed.groupBy("symbol", F.col("bucket").alias("time")).agg(
        F.min_by("last", "__k").alias("open"),
        F.max("last").alias("high"),
        F.min("last").alias("low"),
        F.max_by("last", "__k").alias("close"),
        F.sum("volume").alias("tick_volume"),
        F.avg("spread").alias("spread"),
    )


def resample(bars: DataFrame, width: str, with_volume: bool = True) -> DataFrame:
    """Coarser bars; empty buckets do not appear."""
    aggs = [
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
    ]
    if with_volume:
        aggs.append(F.sum("tick_volume").alias("tick_volume"))
    keyed = bars.withColumn("bucket", floor_time("time", width))
    return keyed.groupBy("symbol", "bucket").agg(*aggs).withColumnRenamed("bucket", "time")


def tick_orderflow(ticks: DataFrame, width: str = "1 hour", min_ticks: int = 5, rows: int | None = None) -> DataFrame:
    """Tick-direction order flow per bar; the first tick of a bar has no direction.

    The previous tick comes from row chunks, not from a window per bar: one bar may hold any number of ticks.
    """
    numbered = settle(index_rows(ticks, ["symbol"], [F.to_date("time"), second_of_day("time")], ["time", "event_id"]))
    keyed = numbered.withColumn("bucket", floor_time("time", width))
    same = lambda w: F.when(F.lag("bucket").over(w) == F.col("bucket"), F.lag("last").over(w))
    d = rolling(keyed, lambda df, w: df.withColumn("__d", F.signum(F.col("last") - same(w))), back=1, rows=rows)
    buy = F.sum(F.when(F.col("__d") > 0, F.col("volume")).otherwise(0))
    sell = F.sum(F.when(F.col("__d") < 0, F.col("volume")).otherwise(0))
    n = F.count(F.lit(1))
    up, down = F.count_if(F.col("__d") > 0), F.count_if(F.col("__d") < 0)
    return (
        d.groupBy("symbol", F.col("bucket").alias("time"))
        .agg(
            (buy - sell).cast("double").alias("of_cum_delta"),
            ((buy - sell) / F.greatest(buy + sell, F.lit(1))).alias("of_delta_ratio"),
            ((up - down) / F.greatest(n, F.lit(1))).alias("of_tick_imb"),
            F.avg(F.col("ask") - F.col("bid")).alias("of_avg_spread"),
            (buy / F.greatest(buy + sell, F.lit(1))).alias("of_buy_ratio"),
            n.alias("n_ticks"),
        )
        .where(F.col("n_ticks") >= min_ticks)
    )


def m1_orderflow(h1: DataFrame, m1: DataFrame) -> DataFrame:
    """Order flow of the minute bars inside each hour, left-joined to the hourly bars; null without volume."""
    up, down, v = F.col("close") > F.col("open"), F.col("close") < F.col("open"), F.col("tick_volume")
    flow = (
        m1.withColumn("bucket", floor_time("time", "1 hour"))
        .groupBy("symbol", "bucket")
        .agg(
            F.sum(F.when(up, v).otherwise(0)).alias("bv"),
            F.sum(F.when(down, v).otherwise(0)).alias("sv"),
            F.count_if(up).alias("nu"),
            F.count_if(down).alias("nd"),
            F.avg("spread").alias("sp"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("bv") + F.col("sv") > 0)
        .select(
            "symbol",
            F.col("bucket").alias("time"),
            (F.col("bv") - F.col("sv")).cast("double").alias("of_cum_delta"),
            ((F.col("bv") - F.col("sv")) / (F.col("bv") + F.col("sv"))).alias("of_delta_ratio"),
            ((F.col("nu") - F.col("nd")) / F.col("n")).alias("of_tick_imb"),
            F.coalesce("sp", F.lit(0.0)).alias("of_avg_spread"),
            (F.col("bv") / (F.col("bv") + F.col("sv"))).alias("of_buy_ratio"),
        )
    )
    return h1.join(flow, ["symbol", "time"], "left")


def tape_pressure(
    m1: DataFrame, lookback: int = 20, min_bars: int = 10, bearish: float = 0.35, bullish: float = 0.65, active: float = 1.2
) -> DataFrame:
    """Pressure of the last five of the hour's last `lookback` minute bars; hours with fewer than `min_bars` pass."""
    h = m1.withColumn("hour", floor_time("time", "1 hour"))
    w = Window.partitionBy("symbol", "hour").orderBy(F.desc("time"))  # at most 60 minute bars per hour
    rng = F.col("high") - F.col("low")
    recent = h.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= lookback)
    last5 = F.col("__k") <= 5
    agg = recent.groupBy("symbol", F.col("hour").alias("time")).agg(
        F.count(F.lit(1)).alias("n_m1"),
        F.avg(rng).alias("avg_range"),
        F.avg(F.when(last5, (F.col("close") - F.col("low")) / (rng + TINY))).alias("pressure"),
        F.avg(F.when(last5, rng)).alias("range5"),
    )
    enough = (F.col("n_m1") >= min_bars) & (F.col("avg_range") > 0)
    ratio = F.col("range5") / (F.col("avg_range") + TINY)
    return agg.select(
        "symbol",
        "time",
        "n_m1",
        "pressure",
        ratio.alias("range_active"),
        (enough & (F.col("pressure") < bearish) & (ratio > active)).alias("block_buy"),
        (enough & (F.col("pressure") > bullish) & (ratio > active)).alias("block_sell"),
    )
