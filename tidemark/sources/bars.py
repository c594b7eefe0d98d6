"""Bar history files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("time", "open", "high", "low", "close", "tick_volume", "spread")
_RAW = "time string, open double, high double, low double, close double, tick_volume bigint, spread double"


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str = "H1") -> DataFrame:
    """Bars from CSV with `time` as epoch seconds or ISO text; a missing spread is 0.

    The symbol comes from the argument or from the folder layout ``symbol=.../``.
    """
    header = spark.read.option("header", True).csv(path)  # names only: decides which of the seven columns exist
    fields = [f.strip() for f in _RAW.split(",")]
    raw = header.select(
        *[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in fields if f.split()[0] in header.columns],
        *([F.col("symbol")] if symbol is None else [F.lit(symbol).alias("symbol")]),
    )
    epoch = F.timestamp_seconds(F.expr("try_cast(time AS BIGINT)"))
    when = F.coalesce(epoch, F.try_to_timestamp("time")).cast("timestamp_ntz")
    spread = F.coalesce("spread", F.lit(0.0)) if "spread" in raw.columns else F.lit(0.0)
    return raw.select(
        "symbol", F.lit(timeframe).alias("timeframe"), when.alias("time"), "open", "high", "low", "close", "tick_volume",
        spread.alias("spread"),
    )


def write_bars(bars: DataFrame, path: str, fmt: str = "csv") -> None:
    """Canonical seven columns with epoch seconds, one folder per symbol."""
    out = bars.select(
        "symbol", F.unix_seconds(F.col("time").cast("timestamp")).alias("time"), "open", "high", "low", "close", "tick_volume", "spread"
    )
    writer = out.repartition("symbol", F.col("time").cast("long") % 16).write.mode("overwrite").partitionBy("symbol")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, time): the first by all remaining columns, found by partial aggregation."""
    rest = [c for c in bars.columns if c not in ("symbol", "time")]
    return bars.groupBy("symbol", "time").agg(F.min(F.struct(*rest)).alias("r")).select("symbol", "time", "r.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_pages(pages: Sequence[DataFrame], start) -> DataFrame:
    """Overlapping history pages as one series from `start` on."""
    return dedupe_bars(union_all(pages).where(F.col("time") >= F.lit(start).cast("timestamp_ntz")))
