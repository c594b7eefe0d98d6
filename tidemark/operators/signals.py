"""Rule signals and gates.

Functions with a window look at most a few rows back and take numbered bars; the others are row-level rules.
Directions are "buy" / "sell" / null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, as_col, clip
from tidemark.operators.chunks import rolling, running

SLOPE_SCALE = 2.0


def cross_expr(fast: Column, slow: Column, prev_fast: Column, prev_slow: Column) -> Column:
    return F.when((prev_fast <= prev_slow) & (fast > slow), "buy").when((prev_fast >= prev_slow) & (fast < slow), "sell")


def crossover(df: DataFrame, fast: str = "fast", slow: str = "slow", name: str = "signal", rows: int | None = None) -> DataFrame:
    """Moving-average cross on closed bars."""
    build = lambda d, w: d.withColumn(name, cross_expr(F.col(fast), F.col(slow), F.lag(fast).over(w), F.lag(slow).over(w)))
    return rolling(df, build, back=1, rows=rows)


def signal_state(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Direction of every bar with both averages known, fresh at a cross, aligned otherwise."""

    def build(d, w):
        d = d.withColumn("__pf", F.lag("fast").over(w)).withColumn("__ps", F.lag("slow").over(w))
        known = F.col("__pf").isNotNull() & F.col("__ps").isNotNull() & F.col("fast").isNotNull() & F.col("slow").isNotNull()
        cross = cross_expr(F.col("fast"), F.col("slow"), F.col("__pf"), F.col("__ps"))
        side = F.when(F.col("fast") > F.col("slow"), "buy").when(F.col("fast") < F.col("slow"), "sell")
        d = d.withColumn("signal", F.when(known, F.coalesce(cross, side)))
        return d.withColumn("signal_type", F.when(F.col("signal").isNotNull(), F.when(cross.isNotNull(), "fresh").otherwise("aligned"))).drop("__pf", "__ps")

    return rolling(df, build, back=1, rows=rows)


def pullback(df: DataFrame, max_dist: float = 2.0, min_dist: float = 0.1, rows: int | None = None) -> DataFrame:
    """Pullback entry: the previous bar is the trigger, this bar breaks its extreme.

    Needs fast, slow, atr, pb_volume, pb_structure_buy / _sell; honours htf_buy / htf_sell = "block" when present.
    """

    def build(d, w):
        prev = {c: F.lag(c).over(w) for c in ("fast", "slow", "close", "high", "low", "pb_volume", "pb_structure_buy", "pb_structure_sell")}
        d = d.select("*", *[v.alias(f"__p_{c}") for c, v in prev.items()])
        p = lambda c: F.col(f"__p_{c}")
        dist = F.abs(p("close") - p("fast"))
        near = (F.col("atr") > 0) & (F.col("rn") > 3) & dist.between(F.col("atr") * min_dist, F.col("atr") * max_dist) & p("pb_volume")
        free = lambda side: (F.col(f"htf_{side}") != "block") if f"htf_{side}" in d.columns else F.lit(True)
        buy = near & (p("fast") > p("slow")) & p("pb_structure_buy") & (F.col("close") > p("high")) & free("buy")
        sell = near & (p("fast") < p("slow")) & p("pb_structure_sell") & (F.col("close") < p("low")) & free("sell")
        return d.withColumn("pb_signal", F.when(buy, "buy").when(sell, "sell")).drop(*[f"__p_{c}" for c in prev])

    return rolling(df, build, back=1, rows=rows)


def mean_reversion(df: DataFrame, oversold: float = 30, overbought: float = 70, deviation: float = 0.0) -> DataFrame:
    """Oversold above the higher-timeframe average buys, overbought below it sells; an unknown average does not veto."""
    ma = F.col("htf_ma")
    above = F.coalesce(F.col("close") > ma * (1 - deviation), ma.isNull())
    below = F.coalesce(F.col("close") < ma * (1 + deviation), ma.isNull())
    return df.withColumn("mr_signal", F.when((F.col("rsi") < oversold) & above, "buy").when((F.col("rsi") > overbought) & below, "sell"))


def mr_exit(df: DataFrame, rows: int | None = None) -> DataFrame:
    """RSI crossing 50 from below (long exit) or above (short exit)."""

    def build(d, w):
        prev = F.lag("rsi").over(w)
        return d.withColumn("exit_long", F.coalesce((prev < 50) & (F.col("rsi") >= 50), F.lit(False))).withColumn(
            "exit_short", F.coalesce((prev > 50) & (F.col("rsi") <= 50), F.lit(False))
        )

    return rolling(df, build, back=1, rows=rows)


def mtf_signal(df: DataFrame, band: float = 0.5, rows: int | None = None) -> DataFrame:
    """Hourly cross in the direction of the four-hour bias, graded by the quarter-hour cross.

    Needs fast, slow, atr, h4_ma and the aligned m15_fast, m15_slow.
    """

    def build(d, w):
        lag = lambda c: F.lag(c).over(w)
        d = d.withColumn("__h1", cross_expr(F.col("fast"), F.col("slow"), lag("fast"), lag("slow")))
        d = d.withColumn("__m15", cross_expr(F.col("m15_fast"), F.col("m15_slow"), lag("m15_fast"), lag("m15_slow")))
        bias = F.col("close") - F.col("h4_ma")
        side = F.when(F.abs(bias) > F.col("atr") * band, F.when(bias > 0, "buy").otherwise("sell"))
        agreed = (F.col("rn") > 2) & (F.col("atr") > 0) & (F.col("__h1") == side)
        opposed = F.col("__m15").isNotNull() & (F.col("__m15") != F.col("__h1"))
        d = d.withColumn("mtf_signal", F.when(agreed & ~opposed, F.col("__h1")))
        full = F.col("__m15") == F.col("__h1")
        known = F.col("mtf_signal").isNotNull()
        return (
            d.withColumn("mtf_type", F.when(known, F.when(full, "crossover").otherwise("pullback")))
            .withColumn("mtf_confidence", F.when(known, F.when(full, 1.0).otherwise(0.67)).otherwise(0.0)).drop("__h1", "__m15")
        )

    return rolling(df, build, back=1, rows=rows)


def htf_trend(df: DataFrame, soft_mult: float = 0.5) -> DataFrame:
    """allow / soft / block per direction from the aligned htf_close, htf_ma, htf_slope; an unknown average is soft."""
    price, ma, slope = F.col("htf_close"), F.col("htf_ma"), F.coalesce("htf_slope", F.lit(0.0))

    def decide(price_ok: Column, slope_ok: Column) -> Column:
        return F.when(ma.isNull(), "soft").when(price_ok & slope_ok, "allow").when(~price_ok & ~slope_ok, "block").otherwise("soft")

    mult = lambda c: F.when(F.col(c) == "allow", 1.0).when(F.col(c) == "block", 0.0).otherwise(soft_mult)
    out = df.withColumn("htf_buy", decide(price >= ma, slope >= 0)).withColumn("htf_sell", decide(price <= ma, slope <= 0))
    return out.withColumn("htf_buy_mult", mult("htf_buy")).withColumn("htf_sell_mult", mult("htf_sell"))


def regime(
    df: DataFrame, trend: float | str = 25, ranging: float | str = 20, exhaustion: float = 40, exhaustion_slope: float = 2, rows: int | None = None
) -> DataFrame:
    """Five-state regime of adx, h4_adx, d1_adx; thresholds are numbers or columns (percentile thresholds)."""

    def build(d, w):
        t, r = as_col(trend), as_col(ranging)
        slope = F.col("adx") - F.lag("adx", 5).over(w)
        d = d.withColumn("adx_change", slope)
        htf = F.coalesce(F.col("h4_adx") >= r, F.lit(False)) | F.coalesce(F.col("d1_adx") >= r, F.lit(False))
        tired = (F.col("adx") >= exhaustion) & F.coalesce(F.col("adx_change") < -exhaustion_slope, F.lit(False))
        state = (
            F.when(F.col("adx").isNull(), "uncertain").when(tired, "exhaustion").when((F.col("adx") >= t) & htf, "strong_trend")
            .when(F.col("adx") >= t, "weak_trend").when((F.col("adx") <= r) & ~htf, "ranging").otherwise("uncertain")
        )
        return d.withColumn("regime", state)

    return rolling(df, build, back=5, rows=rows)


def fused_score_expr(adx: Column, er: Column, slope: Column, atr: Column) -> Column:
    """45 % ADX, 35 % efficiency ratio, 20 % slope in ATRs, on a 0-100 scale; a bad ATR adds nothing."""
    a = F.when(adx > 0, F.least(F.lit(1.0), adx / 50.0)).otherwise(0.0)
    e = F.coalesce(F.least(F.lit(1.0), er), F.lit(0.0))
    s = F.when((atr > 0) & slope.isNotNull(), F.least(F.lit(1.0), F.abs(slope) / atr * SLOPE_SCALE)).otherwise(0.0)
    return 100.0 * (0.45 * a + 0.35 * e + 0.20 * s)


def fused_score(df: DataFrame, warmup: int = 50, er_period: int = 10, rows: int | None = None) -> DataFrame:
    """Fused regime score per bar from adx, atr and the fast average; null during the warm-up."""

    def build(d, w):
        d = d.withColumn("__step", F.abs(F.col("close") - F.lag("close").over(w)))
        path = F.sum("__step").over(w.rowsBetween(-(er_period - 1), 0))
        d = d.withColumn("er", F.when((F.col("rn") > er_period) & (path > 0), F.abs(F.col("close") - F.lag("close", er_period).over(w)) / path).otherwise(0.0))
        d = d.withColumn("ma_slope", F.col("fast") - F.lag("fast").over(w))
        score = fused_score_expr(F.col("adx"), F.col("er"), F.coalesce("ma_slope", F.lit(0.0)), F.col("atr"))
        return d.withColumn("fused_score", F.when(F.col("rn") > warmup, score)).drop("__step")

    return rolling(df, build, back=er_period + 1, rows=rows)


def hysteresis(df: DataFrame, score: str = "fused_score", threshold: float = 50.0, buffer: float = 5.0, by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    """Gate that opens above threshold + buffer/2 and closes below threshold - buffer/2.

    The state is the last decisive event; a null score reads closed and leaves the state as it is.
    """
    s = F.col(score)
    event = F.when(s > threshold + buffer / 2, True).when(s < threshold - buffer / 2, False)
    out = running(df, {"gate_open": ("last", event)}, by, rows)
    return out.withColumn("gate_open", s.isNotNull() & F.coalesce("gate_open", F.lit(False)))


def entry_score(df: DataFrame, weights: Mapping[str, float] | Column | None = None) -> DataFrame:
    """Weighted mean of the component columns that are known; sells mirror the news component.

    Components are ml, spread, news (and any other column named in the weights).
    """
    table = weights if isinstance(weights, Mapping) else {"ml": 0.40, "spread": 0.30, "news": 0.30}
    value = lambda k: F.when(F.col("signal") == "sell", 1 - F.col(k)).otherwise(F.col(k)) if k == "news" else F.col(k)
    weight = (lambda k: F.try_element_at(weights, F.lit(k))) if isinstance(weights, Column) else (lambda k: F.lit(float(table[k])))
    used = [(value(k), F.coalesce(weight(k), F.lit(0.0))) for k in table]
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in used), F.lit(0.0))
    wsum = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in used), F.lit(0.0))
    return df.withColumn("entry_score", F.when(wsum > 0, total / wsum).otherwise(1.0))


def spread_score(spread: Column, atr: Column, point: float, max_ratio: float = 0.30) -> Column:
    """1 at no spread, 0 at the allowed spread/ATR ratio; 0.5 where either is unknown."""
    known = (spread > 0) & (atr > 0)
    return F.when(F.coalesce(known, F.lit(False)), F.greatest(F.lit(0.0), 1 - spread * point / atr / max(max_ratio, 0.01))).otherwise(0.5)


def ml_score(conf: Column, threshold: Column, fallback: float = 0.60) -> Column:
    return F.coalesce(F.least(F.lit(1.0), conf / F.greatest(threshold, F.lit(0.01))), F.lit(fallback))


def confidence_bucket(df: DataFrame, min_score: float = 0.60, high: float = 0.85, low: float = 0.60, mults=(1.0, 0.85, 0.50)) -> DataFrame:
    """Pass flag and size multiplier of an entry score, adjusted by the (already mirrored) news value."""
    s = F.col("entry_score")
    base = F.when(s >= high, mults[0]).when(s >= low, mults[1]).otherwise(mults[2])
    news = F.coalesce("news", F.lit(0.5))
    adjusted = F.when(news >= 0.70, F.least(F.lit(1.5), base * 1.10)).when(news <= 0.30, base * 0.50).otherwise(base)
    return df.withColumn("score_ok", s >= min_score).withColumn("confidence_mult", F.when(s >= min_score, adjusted).otherwise(0.0))


def execution_gate(df: DataFrame) -> DataFrame:
    """Volume, spread and tape checks together, per direction; a missing tape reading passes."""
    tape = lambda side: ~F.coalesce(F.col(f"block_{side}"), F.lit(False))
    return df.withColumn("exec_buy", F.col("pass_buy") & F.col("spread_ok") & tape("buy")).withColumn(
        "exec_sell", F.col("pass_sell") & F.col("spread_ok") & tape("sell")
    )


def bias_freeze(df: DataFrame, max_flips: int = 3) -> DataFrame:
    """Direction flips of the day so far (column bias_signal) and whether entries in each direction stay allowed."""
    day = Window.partitionBy("symbol", F.to_date("time")).orderBy("rn")  # one day of bars
    prev = F.last("bias_signal", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, -1))
    flip = F.when(F.col("bias_signal").isNotNull() & F.col("__prev").isNotNull() & (F.col("bias_signal") != F.col("__prev")), 1).otherwise(0)
    out = df.withColumn("__prev", prev).withColumn("__flip", flip)
    out = out.withColumn("flips", F.sum("__flip").over(day.rowsBetween(Window.unboundedPreceding, 0))).drop("__prev", "__flip")
    ok = lambda side: (F.col("flips") < max_flips) & F.coalesce(F.col("bias_signal") == side, F.lit(True))
    return out.withColumn("bias_buy", ok("buy")).withColumn("bias_sell", ok("sell"))


def select_entry(df: DataFrame) -> DataFrame:
    """Cross before pullback, mean reversion first while ranging; a shut gate drops crosses only."""
    trending = F.col("regime").isin("strong_trend", "weak_trend", "uncertain")
    pb = F.when(F.col("signal").isNull() & trending, F.col("pb_signal"))
    mr = F.when(F.col("regime") == "ranging", F.col("mr_signal"))
    kind = F.when(mr.isNotNull(), "mean_reversion").when(F.col("signal").isNotNull(), "crossover").when(pb.isNotNull(), "pullback")
    chosen = F.coalesce(mr, F.col("signal"), pb)
    shut = (kind == "crossover") & ~F.col("gate_open")
    return df.withColumn("entry", F.when(~F.coalesce(shut, F.lit(False)), chosen)).withColumn("entry_type", F.when(~F.coalesce(shut, F.lit(False)), kind))


def volatility_mult(df: DataFrame, n: int = 50, rows: int | None = None) -> DataFrame:
    """ATR against its n-bar mean; above 1.2 the size shrinks by the ratio, at most to a quarter."""

    def build(d, w):
        sma = F.when(F.count("atr").over(w.rowsBetween(-(n - 1), 0)) >= n, F.avg("atr").over(w.rowsBetween(-(n - 1), 0)))
        d = d.withColumn("__sma", sma)
        ratio = F.when((F.col("__sma") > 0) & (F.col("atr") > 0), F.col("atr") / F.col("__sma"))
        return d.withColumn("vol_mult", F.when(ratio > 1.2, F.greatest(F.lit(0.25), 1 / ratio)).otherwise(1.0)).drop("__sma")

    return rolling(df, build, back=n - 1, rows=rows)


def component_scores(df: DataFrame, kappa: float = 1.2, vol_n: int = 20, atr_n: int = 20, min_ratio: float = 0.5, max_spread: float = 0.30, rows: int | None = None) -> DataFrame:
    """Per-bar component scores in [0, 1] from fast, slow, atr, spread; 0.5 where unknown."""

    def build(d, w):
        lag = lambda c: F.lag(c).over(w)
        known = F.col("fast").isNotNull() & F.col("slow").isNotNull()
        fresh = F.coalesce((lag("fast") <= lag("slow")) & (F.col("fast") > F.col("slow")), F.lit(False))
        ex = F.when(~known, 0.5).when(fresh, 1.0).when(F.col("fast") > F.col("slow"), 0.7).otherwise(0.3)
        vol = F.avg("tick_volume").over(w.rowsBetween(-(vol_n - 1), 0))
        sma = F.avg("atr").over(w.rowsBetween(-(atr_n - 1), 0))
        d = d.withColumn("__vol", vol).withColumn("__sma", sma)
        volume = F.coalesce(F.when(F.col("__vol") > 0, F.least(F.lit(1.0), F.col("tick_volume") / F.col("__vol") / kappa)), F.lit(0.5))
        ratio = F.coalesce(F.when(F.col("__sma") != 0, F.col("atr") / F.col("__sma")), F.lit(1.0))
        a = F.coalesce(F.when(F.col("atr") != 0, F.col("atr")), F.lit(0.001))
        return d.withColumns({
            "exec": ex, "volume": volume, "volatility": F.least(F.lit(1.0), ratio / max(min_ratio, 0.01)),
            "spread_sc": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("spread") / a / max(max_spread, 0.01))),
            "news": F.lit(0.5), "ml": F.lit(0.5), "tail_risk": F.lit(1.0),
        }).drop("__vol", "__sma")

    return rolling(df, build, back=max(vol_n, atr_n), rows=rows)
