"""Position sizing, stop levels and exit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, as_col, clip, round_step, target_at
from tidemark.operators.chunks import rolling, running


def daily_open_positions(bars: DataFrame) -> DataFrame:
    """One position per (symbol, day) at the first bar, in its direction, with stops at one and two bar ranges."""
    first = (
        bars.groupBy("symbol", F.to_date("time").alias("day"))
        .agg(F.min_by(F.struct("time", "open", "high", "low", "close"), "time").alias("b"))
        .select("symbol", "day", "b.*")
    )
    up = F.col("close") >= F.col("open")
    rng = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    days = Window.partitionBy("symbol").orderBy("time")  # one row per calendar day
    return first.select(
        "symbol",
        F.row_number().over(days).cast("long").alias("day_no"),
        "time",
        F.when(up, "buy").otherwise("sell").alias("type"),
        F.lit(1.0).alias("volume"),
        F.col("close").alias("price_open"),
        F.when(up, F.col("close") - rng).otherwise(F.col("close") + rng).alias("sl"),
        F.when(up, F.col("close") + 2 * rng).otherwise(F.col("close") - 2 * rng).alias("tp"),
        rng.alias("atr_entry"),
    )


def position_size(
    df: DataFrame, balance: float, risk_pct: float = 1.0, mult: Column | float = 1.0, max_risk_ratio: float = 2.0, max_tail_pct: float = 1.5
) -> DataFrame:
    """Lots for a stop distance in points (column sl_points) with the symbol's metadata columns; 0 means skip."""
    risk = balance * risk_pct / 100
    usable = (F.col("tick_size") != 0) & (F.col("tick_value") != 0) & (F.col("sl_points") > 0)
    value = F.when(usable, F.col("sl_points") * F.col("point") / F.col("tick_size") * F.col("tick_value"))
    step = F.when(F.col("volume_step") > 0, F.col("volume_step")).otherwise(0.01)
    raw = F.lit(risk) / F.greatest(value, F.lit(TINY))
    too_small = (raw < step) & (step * value / max(risk, TINY) > max_risk_ratio)
    lots = F.least(F.greatest(round_step(raw * as_col(mult), step), F.col("volume_min")), F.col("volume_max"))
    skip = value.isNull() | too_small | (lots * value > balance * max_tail_pct / 100)
    return df.withColumn("sl_value", value).withColumn("lots", F.when(skip, 0.0).otherwise(lots))


REGIME_MULT = {"strong_trend": 1.0, "uncertain": 0.5}


def size_multiplier(df: DataFrame, mr_mult: float = 0.5) -> DataFrame:
    """Product of the regime multiplier and whatever multiplier columns are present."""
    base = F.when(F.col("entry_type") == "mean_reversion", mr_mult).when(F.col("regime") == "strong_trend", 1.0).when(F.col("regime") == "uncertain", 0.5).otherwise(0.75)
    chain = [c for c in ("kelly_mult", "vol_mult", "ml_mult", "confidence_mult", "corr_mult", "htf_mult") if c in df.columns]
    out = base
    for c in chain:
        out = out * F.coalesce(c, F.lit(1.0))
    return df.withColumn("size_mult", out)


def budget_scale(df: DataFrame, balance: float, open_risk: Column | float, risk_pct: float = 1.0, budget_pct: float = 3.0, lo: float = 0.25, hi: float = 1.5) -> DataFrame:
    """Shrink a size multiplier whose added risk would exceed the portfolio budget, then clamp it."""
    m = F.col("size_mult")
    total = as_col(open_risk) + m * (balance * risk_pct / 100)
    budget = balance * budget_pct / 100
    scaled = F.when(total > budget, m * budget / F.greatest(total, F.lit(1.0))).otherwise(m)
    return df.withColumn("size_mult", clip(scaled, lo, hi))


def stop_levels(df: DataFrame, sl_mult: float = 1.0, rr: float = 2.0, mr_sl: float = 1.0, mr_tp: float = 1.5, point: float = 0.01, min_points: int = 50) -> DataFrame:
    """Stop and target prices in whole points from the ATR, wider targets for mean reversion entries."""
    mr = F.coalesce(F.col("entry_type") == "mean_reversion", F.lit(False))
    whole = lambda x: F.floor(x)
    slp = F.greatest(whole(F.col("atr") * F.when(mr, mr_sl).otherwise(sl_mult) / point), F.lit(min_points))
    tpp = F.when(mr, whole(F.col("atr") * mr_tp / point)).otherwise(whole(slp * rr))
    side = F.when(F.col("signal") == "buy", 1.0).otherwise(-1.0)
    return df.withColumn("sl_points", slp).withColumn("tp_points", tpp).withColumn("sl", F.col("close") - side * F.col("sl_points") * point).withColumn(
        "tp", F.col("close") + side * F.col("tp_points") * point
    )


def chandelier(held: DataFrame, mult: Column, level: Column, keys=("symbol", "day_no")) -> DataFrame:
    """Trailing stop at every bar since the entry (one row per position and bar: bar_time, high, low, close, atr).

    Extreme since entry minus ATR times `mult`, never loosened; `mult` may name ``partial``, whether a bar after the entry has
    reached `level`. The result itself is positions x bars: where only the exit or the newest stop is asked for, use
    ``trailing.trail`` or ``trailing.extreme_between``.
    """
    w = Window.partitionBy(*keys).orderBy("bar_time").rowsBetween(Window.unboundedPreceding, 0)
    long = F.col("type") == "buy"
    hit = (F.col("bar_time") > F.col("entry_time")) & F.when(long, F.col("high") >= level).otherwise(F.col("low") <= level)
    out = held.withColumn("partial", F.coalesce(F.max(F.when(hit, True)).over(w), F.lit(False)))
    raw = F.when(long, F.max("high").over(w) - F.col("atr") * mult).otherwise(F.min("low").over(w) + F.col("atr") * mult)
    out = out.withColumn("__raw", raw)
    stop = F.when(long, F.greatest(F.max("__raw").over(w), F.col("sl"))).otherwise(F.least(F.min("__raw").over(w), F.col("sl")))
    out = out.withColumn("stop", stop).drop("__raw")
    return out.withColumn("breached", F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop")))


def scale_out_levels(positions: DataFrame, targets, fractions, rr: float = 2.0, lock: float = 0.25, volume_step: float = 0.01) -> DataFrame:
    """Price level, closed volume and new stop of every scale-out step (distance = stop distance times rr)."""
    side = F.when(F.col("type") == "buy", 1.0).otherwise(-1.0)
    dist = F.abs(F.col("price_open") - F.col("sl")) * rr
    t, f = F.array(*[F.lit(float(x)) for x in targets]), F.array(*[F.lit(float(x)) for x in fractions])
    steps = positions.select("*", F.posexplode(f).alias("step", "fraction"))
    target = target_at(t, F.col("step"))
    locked = F.when(F.col("step") == 0, F.lit(lock)).otherwise(target_at(t, F.col("step") - 1))
    vol = F.greatest(F.floor(F.col("volume") * F.col("fraction") / volume_step + 1e-9) * volume_step, F.lit(volume_step))
    return steps.withColumn("level", F.col("price_open") + side * dist * target).withColumn("close_volume", vol).withColumn(
        "new_sl", F.col("price_open") + side * dist * locked
    )


def breakeven(positions: DataFrame, quotes: DataFrame, atr_mult: float = 1.0) -> DataFrame:
    """Positions at least `atr_mult` ATRs in profit whose stop has not passed the entry yet."""
    p = positions.join(quotes, "symbol")
    side = F.when(F.col("type") == "buy", 1.0).otherwise(-1.0)
    profit = (F.col("price_current") - F.col("price_open")) * side
    open_stop = (F.col("sl") - F.col("price_open")) * side < 0
    atrs = F.when(F.col("atr_entry") > 0, profit / F.col("atr_entry")).otherwise(0.0)
    return p.withColumn("profit_atrs", atrs).withColumn("to_breakeven", (profit > 0) & (atrs >= atr_mult) & F.coalesce(open_stop, F.lit(True)))


def max_hold(positions: DataFrame, now: Column, hours: float = 72.0) -> DataFrame:
    from tidemark.functions.times import epoch_seconds

    elapsed = (F.unix_seconds(now.cast("timestamp")) - epoch_seconds("time")) / 3600.0
    return positions.withColumn("held_hours", elapsed).withColumn("expired", F.lit(hours > 0) & (elapsed >= hours))


def reversal_exit(positions: DataFrame, signals: DataFrame, band: float = 0.25) -> DataFrame:
    """Opposite signal of the symbol closes a position that is not more than `band` ATRs in profit.

    `signals` holds the current signal, close and atr per symbol.
    """
    p = positions.join(signals.select("symbol", "signal", F.col("close").alias("price_current"), "atr"), "symbol")
    side = F.when(F.col("type") == "buy", 1.0).otherwise(-1.0)
    safe = F.coalesce((F.col("atr") > 0) & ((F.col("price_current") - F.col("price_open")) * side > F.col("atr") * band), F.lit(False))
    return p.withColumn("reverse", F.coalesce(F.col("signal") != F.col("type"), F.lit(False)) & ~safe)
