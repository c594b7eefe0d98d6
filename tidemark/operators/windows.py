"""Bounded row-frame indicators and cumulative analytics over numbered bars.

Each function returns the bars with new columns; ``rows`` is the chunk size passed on to the chunked frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, correlation, safe_div
from tidemark.operators.chunks import chunk_of, rolling, running


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def when_full(value: Column, n: int) -> Column:
    """Null until `n` rows of the symbol exist."""
    return F.when(F.col("rn") >= n, value)


def add_returns(df: DataFrame, w: WindowSpec, ks: Sequence[int]) -> DataFrame:
    return df.select("*", *[(F.col("close") / F.lag("close", k).over(w) - 1).alias(f"ret_{k}") for k in ks])


def returns(bars: DataFrame, ks: Sequence[int] = (1, 5, 20, 50), rows: int | None = None) -> DataFrame:
    return rolling(bars, lambda df, w: add_returns(df, w, ks), back=max(ks), rows=rows)


def forward_returns(signals: DataFrame, ks: Sequence[int] = (12, 24, 48), rows: int | None = None) -> DataFrame:
    """Return over the next k bars, negated for sells (column `signal`)."""
    sign = F.when(F.col("signal") == "sell", -1).otherwise(1)
    ahead = lambda df, w: df.select("*", *[((F.lead("close", k).over(w) - F.col("close")) / F.col("close") * sign).alias(f"fwd_{k}") for k in ks])
    return rolling(signals, ahead, ahead=max(ks), rows=rows)


def rel_volume(bars: DataFrame, n: int = 20, rows: int | None = None) -> DataFrame:
    """Volume over its n-bar mean (null until n bars)."""

    def build(df, w):
        sma = when_full(F.avg("tick_volume").over(last_rows(w, n)), n)
        return df.withColumn("vol_sma", sma).withColumn("vol_ratio", safe_div("tick_volume", "vol_sma"))

    return rolling(bars, build, back=n - 1, rows=rows)


def rolling_vol(bars: DataFrame, n: int = 20, rows: int | None = None) -> DataFrame:
    """Sample deviation of one-bar returns; Bollinger width 2 sigma / mean."""

    def build(df, w):
        df = add_returns(df, w, [1]) if "ret_1" not in df.columns else df
        f = last_rows(w, n)
        df = df.withColumn("volatility_20", when_full(F.stddev_samp("ret_1").over(f), n + 1))
        return df.withColumn("bb_width", when_full(safe_div(2 * F.stddev_samp("close").over(f), F.avg("close").over(f)), n))

    return rolling(bars, build, back=n, rows=rows)


def moments_expr(x: str, f: WindowSpec) -> tuple[Column, Column]:
    """Bias-corrected skew and excess kurtosis of a frame from Spark's population moments (null when undefined)."""
    n = F.count(x).over(f).cast("double")
    varied = F.stddev_pop(x).over(f) > 0
    skew = F.when((n >= 3) & varied, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x).over(f))
    kurt = F.when((n >= 4) & varied, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(f) + 6))
    return skew, kurt


def rolling_moments(bars: DataFrame, n: int = 20, rows: int | None = None) -> DataFrame:
    def build(df, w):
        df = add_returns(df, w, [1]) if "ret_1" not in df.columns else df
        skew, kurt = moments_expr("ret_1", last_rows(w, n))
        full = F.col("rn") >= n + 1
        return df.withColumn("skew_20", F.when(full, skew)).withColumn("kurt_20", F.coalesce(F.when(full, kurt), F.lit(0.0)))

    return rolling(bars, build, back=n, rows=rows)


def rolling_autocorr(bars: DataFrame, n: int = 50, lag: int = 5, rows: int | None = None) -> DataFrame:
    """Lag-`lag` autocorrelation of one-bar returns inside an n-bar window; 0 for a constant window."""

    def build(df, w):
        df = add_returns(df, w, [1]) if "ret_1" not in df.columns else df
        df = df.withColumn("__lagged", F.lag("ret_1", lag).over(w))
        pairs = last_rows(w, n - lag)
        value = correlation("ret_1", "__lagged", pairs)
        flat = F.stddev_pop("ret_1").over(last_rows(w, n)) == 0
        out = F.when(flat, 0.0).otherwise(F.when(~F.isnan(value), value))
        return df.withColumn("autocorr_5", when_full(out, n + 1)).drop("__lagged")

    return rolling(bars, build, back=n, rows=rows)


def volume_rank(bars: DataFrame, n: int = 20, at_least: int = 10, rows: int | None = None) -> DataFrame:
    """Volume's place in its n-bar range; 0.5 before `at_least` bars."""

    def build(df, w):
        f = last_rows(w, n)
        lo, hi = F.min("tick_volume").over(f), F.max("tick_volume").over(f)
        return df.withColumn("volume_rank_20", F.when(F.col("rn") >= at_least, (F.col("tick_volume") - lo) / F.greatest(hi - lo, F.lit(TINY))).otherwise(0.5))

    return rolling(bars, build, back=n - 1, rows=rows)


def signed_volume(df: DataFrame, w: WindowSpec) -> Column:
    move = F.col("close") - F.lag("close").over(w)
    return F.coalesce(F.signum(move), F.lit(0.0)).cast("long") * F.col("tick_volume")


def obv(bars: DataFrame, slope: int = 5, rows: int | None = None) -> DataFrame:
    """On-balance volume (exact integer running sum) and its slope per bar."""
    signed = rolling(bars, lambda df, w: df.withColumn("__sv", signed_volume(df, w)), back=1, rows=rows)
    total = running(signed, {"obv": ("sum", F.col("__sv"))}, rows=rows)
    build = lambda df, w: df.withColumn("obv_slope_5", (F.col("obv") - F.lag("obv", slope).over(w)) / slope)
    return rolling(total.drop("__sv"), build, back=slope, rows=rows)


def vwap(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Cumulative volume-weighted typical price and the close's distance from it."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    sums = running(bars, {"__pv": ("sum", typical * F.col("tick_volume")), "__v": ("sum", F.col("tick_volume"))}, rows=rows)
    out = sums.withColumn("vwap", safe_div("__pv", F.col("__v").cast("double"))).drop("__pv", "__v")
    return out.withColumn("vwap_dist", safe_div(F.col("close") - F.col("vwap"), "close"))


def frac_weights(d: float, n: int) -> list[float]:
    w = [1.0]
    for k in range(1, n):
        w.append(-w[-1] * (d - k + 1) / k)
    return w


def frac_diff(bars: DataFrame, d: float, window: int = 100, name: str = "fd_close", compat: bool = False, rows: int | None = None) -> DataFrame:
    """Fractional difference of the close over its price, with a fixed window; 0 while the window is incomplete.

    ``compat`` applies the weights to the oldest value first.
    """
    weights = frac_weights(d, window)
    ordered = weights if compat else weights[::-1]  # the frame lists the oldest value first

    def build(df, w):
        values = F.collect_list("close").over(last_rows(w, window))
        products = F.zip_with(values, F.array(*[F.lit(x) for x in ordered]), lambda a, b: a * b)
        total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
        return df.withColumn(name, F.when(F.col("rn") >= window, total / F.greatest("close", F.lit(TINY))).otherwise(0.0))

    return rolling(bars, build, back=window - 1, rows=rows)


def efficiency_ratio(bars: DataFrame, n: int = 10, legacy: bool = False, rows: int | None = None) -> DataFrame:
    """Net move over path length of the last n changes (`legacy`: n - 1 changes); 0 before that or on a flat path."""
    k = n - 1 if legacy else n

    def build(df, w):
        df = df.withColumn("__step", F.abs(F.col("close") - F.lag("close").over(w)))
        path = F.sum("__step").over(last_rows(w, k))
        net = F.abs(F.col("close") - F.lag("close", k).over(w))
        return df.withColumn("er", F.when((F.col("rn") > n) & (path > 0), net / path).otherwise(0.0)).drop("__step")

    return rolling(bars, build, back=n + 1, rows=rows)


def true_range(bars: DataFrame, rows: int | None = None) -> DataFrame:
    def build(df, w):
        prev = F.lag("close").over(w)
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
        return df.withColumn("tr", tr)

    return rolling(bars, build, back=1, rows=rows)


def day_start(bars: DataFrame) -> DataFrame:
    """Row number of the first bar of each bar's calendar day."""
    day = Window.partitionBy("symbol", F.to_date("time"))  # at most one day of bars
    return bars.withColumn("day_start", F.min("rn").over(day))


def obv_divergence_expr(df: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    """Flags `obv_div_buy` / `obv_div_sell` over the last n + 1 bars; needs column __obv (any additive origin)."""
    f = w.rowsBetween(-n, 0)
    first = F.min("rn").over(f)
    low = F.min(F.struct(F.col("close").alias("v"), F.col("rn").alias("at"), F.col("__obv").alias("o"))).over(f)
    high = F.min(F.struct((-F.col("close")).alias("v"), F.col("rn").alias("at"), F.col("__obv").alias("o"))).over(f)
    enough = F.col("rn") >= 3
    df = df.withColumn("__lo", low).withColumn("__hi", high).withColumn("__first", first)
    return (
        df.withColumn("obv_div_buy", enough & (F.col("__lo.at") > F.col("__first")) & (F.col("__obv") > F.col("__lo.o")))
        .withColumn("obv_div_sell", enough & (F.col("__hi.at") > F.col("__first")) & (F.col("__obv") < F.col("__hi.o")))
        .drop("__lo", "__hi", "__first")
    )


def _chunk_obv(df: DataFrame, w: WindowSpec) -> DataFrame:
    """OBV counted from the chunk's first row: differences inside a frame do not depend on the origin."""
    df = df.withColumn("__sv", signed_volume(df, w))
    return df.withColumn("__obv", F.sum("__sv").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__sv")


def obv_divergence(bars: DataFrame, n: int = 20, rows: int | None = None) -> DataFrame:
    return rolling(bars, lambda df, w: obv_divergence_expr(_chunk_obv(df, w), w, n).drop("__obv"), back=n + 1, rows=rows)


def volume_filter(bars: DataFrame, kappa: float = 1.2, sma: int = 20, lookback: int = 20, rows: int | None = None) -> DataFrame:
    """Pass flags per direction: enough relative volume or an OBV divergence; short history passes."""

    def build(df, w):
        df = obv_divergence_expr(_chunk_obv(df, w), w, lookback)
        mean = F.avg("tick_volume").over(last_rows(w, sma))
        free = (F.col("rn") < sma + 5) | (mean <= 0) | (F.col("tick_volume") / mean >= kappa)
        df = df.withColumn("__free", free)
        return (
            df.withColumn("pass_buy", F.col("__free") | F.col("obv_div_buy")).withColumn("pass_sell", F.col("__free") | F.col("obv_div_sell"))
            .drop("__free", "__obv")
        )

    return rolling(bars, build, back=max(sma, lookback + 1), rows=rows)


def tail_event(bars: DataFrame, n: int = 50, k: float = 3.0, rows: int | None = None) -> DataFrame:
    """Last return more than k population deviations from the mean of the last n returns."""

    def build(df, w):
        df = add_returns(df, w, [1]) if "ret_1" not in df.columns else df
        f = last_rows(w, n)
        mean, sd = F.avg("ret_1").over(f), F.stddev_pop("ret_1").over(f)
        return df.withColumn("tail_event", F.coalesce((F.col("rn") > n) & (sd > 0) & (F.abs(F.col("ret_1") - mean) / sd > k), F.lit(False)))

    return rolling(bars, build, back=n, rows=rows)


def drawdown(df: DataFrame, col: str, by: Sequence[str] = ("symbol",), halt: float = 8.0, breaker: float = 15.0, rows: int | None = None) -> DataFrame:
    """Percent below the running peak, with the halt and breaker flags."""
    out = running(df, {"peak": ("max", F.col(col))}, by, rows)
    dd = (F.col("peak") - F.col(col)) / F.greatest("peak", F.lit(TINY)) * 100
    return out.withColumn("dd_pct", dd).withColumn("halt", dd >= halt).withColumn("breaker", dd >= breaker)


def day_loss(trades: DataFrame, base: float, limit_pct: float = 5.0, rows: int | None = None) -> DataFrame:
    """Realized result of the day so far at every trade, as percent of equity, against the limit (numbered trades).

    Sums inside a chunk, of the symbol and of the day, are windows on one partitioning. What lies before the chunk
    comes from totals per chunk, and per chunk and day, of which there are few.
    """
    by = ["symbol"]
    day = F.coalesce(F.to_date("time"), F.lit("0001-01-01").cast("date"))  # rows without a time are one day
    base_rows = trades.withColumn("chunk", chunk_of(rows)).withColumn("__day", day)
    upto = lambda *keys: Window.partitionBy(*by, *keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    local = base_rows.withColumn("__cum", F.sum("pnl").over(upto("chunk"))).withColumn("__own", F.sum("pnl").over(upto("chunk", "__day")))
    parts = base_rows.groupBy(*by, "chunk", "__day").agg(F.sum("pnl").alias("__n"))
    earlier = lambda *keys: Window.partitionBy(*by, *keys).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*by, "chunk", "__day", F.sum("__n").over(earlier()).alias("__before"), F.sum("__n").over(earlier("__day")).alias("__day_before"))
    out = local.join(carry, [*by, "chunk", "__day"])
    plus = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(b)).cast("double")
    day_pnl, equity = plus("__day_before", "__own"), plus("__before", "__cum") + base
    loss = F.when((day_pnl < 0) & (equity > 0), -day_pnl / equity * 100).otherwise(0.0)
    return (
        out.withColumn("day_pnl", day_pnl).withColumn("loss_pct", loss).withColumn("allowed", (equity <= 0) | (loss < limit_pct))
        .select(*trades.columns, "day_pnl", "loss_pct", "allowed")
    )


def cross_asset_features(bars: DataFrame, ref_symbol: str, n: int = 20, at_least: int = 10, rows: int | None = None) -> DataFrame:
    """Price ratio to a reference symbol, its return, and the rolling correlation of returns (0 with few pairs)."""
    from tidemark.operators.joins import cross_asset_join

    joined = cross_asset_join(bars, ref_symbol)

    def build(df, w):
        prev = F.lag("ref_close").over(w)
        df = df.withColumn("__main", F.col("close") / F.lag("close").over(w) - 1).withColumn("ref_ret", F.col("ref_close") / prev - 1)
        f = last_rows(w, n)
        both = F.col("__main").isNotNull() & F.col("ref_ret").isNotNull()
        df = df.withColumn("__x", F.when(both, F.col("__main"))).withColumn("__y", F.when(both, F.col("ref_ret")))
        c = correlation("__x", "__y", f)
        ok = (F.col("rn") > n) & (F.count("__x").over(f) >= at_least)
        return df.withColumn("corr_20", F.when(ok & ~F.isnan(c), c).otherwise(0.0)).drop("__main", "__x", "__y")

    return rolling(joined, build, back=n, rows=rows)


def sequences(df: DataFrame, cols: Sequence[str], n: int = 20, rows: int | None = None) -> DataFrame:
    """The last n feature rows of every bar as an array (null while incomplete)."""

    def build(d, w):
        arr = F.collect_list(F.struct(*cols)).over(last_rows(w, n))
        return d.withColumn("sequence", F.when(F.col("rn") >= n, arr))

    return rolling(df, build, back=n - 1, rows=rows)


def pullback_checks(bars: DataFrame, sma: int = 20, threshold: float = 0.8, lookback: int = 5, rows: int | None = None) -> DataFrame:
    """Low-volume and structure checks of each bar as a pullback trigger; short history passes."""

    def build(df, w):
        mean = F.avg("tick_volume").over(last_rows(w, sma))
        prior = w.rowsBetween(-lookback, -1)
        quiet = (F.col("rn") <= sma) | (mean <= 0) | (F.col("tick_volume") < mean * threshold)
        short = F.col("rn") <= lookback
        return (
            df.withColumn("pb_volume", quiet)
            .withColumn("pb_structure_buy", short | (F.col("low") > F.min("low").over(prior)))
            .withColumn("pb_structure_sell", short | (F.col("high") < F.max("high").over(prior)))
        )

    return rolling(bars, build, back=max(sma, lookback), rows=rows)
