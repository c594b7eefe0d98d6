"""The model's feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, correlation, safe_div

from tidemark.operators import indicators as I
from tidemark.operators import projections as P
from tidemark.operators import windows as N
from tidemark.operators.chunks import index_rows, rolling, running
from tidemark.operators.joins import prev_period_join
from tidemark.operators.resample import m1_orderflow, resample
from tidemark.session import settle

# The model's feature names in their order.
FEATURE_COLS = (
    "ret_5 ret_20 rsi_14 kama9_ratio kama21_ratio kama50_ratio kama9_21_diff macd macd_signal macd_hist atr_ratio bb_width volatility_20 vol_ratio "
    "obv_slope_5 skew_20 kurt_20 autocorr_5 ret_5_x_vol_20 adx_14 di_plus_14 di_minus_14 hour_sin hour_cos day_sin day_cos vwap_dist kama200_ratio "
    "atr_ratio_5_14 ret_50 atr_ratio_14_50 kama100_ratio hl_range_ratio adx_slope_5 kama_slope_5 volume_rank_20 fd_close_d03 d1_kama_ratio d1_adx "
    "d1_ret_5pct d1_ret_20pct h4_adx is_london atr_sma_ratio dist_swing_high_20 dist_swing_low_20 of_cum_delta of_delta_ratio of_tick_imb "
    "of_avg_spread of_buy_ratio news_score"
).split()

KAMAS = (4, 9, 12, 21, 26, 50, 100, 200)


def multi_tf_features(bars: DataFrame, d1_kama: int = 50, rows: int | None = None) -> DataFrame:
    """Daily and four-hour features of the previous completed bucket, joined by calendar bucket."""
    d1 = settle(index_rows(resample(bars, "1 day", False), ["symbol"], [F.year("time")], ["time"]))
    d1 = I.adx_ewm(d1, 14, "d1_adx", di=False, rows=rows)
    d1 = I.scan_parts(settle(d1), [I.kama_part("__k", d1_kama)], rows=rows)
    d1 = d1.withColumn("d1_kama_ratio", safe_div("close", "__k"))
    pct = lambda k, w: F.col("close") / F.lag("close", k).over(w) - 1
    d1 = settle(rolling(d1, lambda d, w: d.withColumn("d1_ret_5pct", pct(5, w)).withColumn("d1_ret_20pct", pct(20, w)), back=20, rows=rows))
    h4 = settle(index_rows(resample(bars, "4 hours", False), ["symbol"], [F.year("time")], ["time"]))
    h4 = settle(I.adx_ewm(h4, 14, "h4_adx", di=False, rows=rows))
    out = prev_period_join(bars, d1, ["d1_kama_ratio", "d1_adx", "d1_ret_5pct", "d1_ret_20pct"], "1 day")
    return prev_period_join(out, h4, ["h4_adx"], "4 hours")


def regime_ratios(df: DataFrame, rows: int | None = None) -> DataFrame:
    """ATR against its 50-bar mean, distances to the previous 20-bar extremes, five-bar ADX slope."""

    def build(d, w):
        sma = F.when(F.col("rn") >= 14, F.avg("atr_14").over(w.rowsBetween(-49, 0)))
        prior = w.rowsBetween(-20, -1)
        enough = F.col("rn") > 5
        hi, lo = F.when(enough, F.max("high").over(prior)), F.when(enough, F.min("low").over(prior))
        d = d.withColumn("__sma", sma).withColumn("__hi", hi).withColumn("__lo", lo)
        return d.withColumns({
            "atr_sma_ratio": safe_div("atr_14", "__sma"),
            "dist_swing_high_20": safe_div(F.col("close") - F.col("__hi"), "atr_14"),
            "dist_swing_low_20": safe_div(F.col("close") - F.col("__lo"), "atr_14"),
            "adx_slope_5": (F.col("adx_14") - F.lag("adx_14", 5).over(w)) / 5.0,
        }).drop("__sma", "__hi", "__lo")

    return rolling(df, build, back=50, rows=rows)


def compute_features(bars: DataFrame, m1: DataFrame | None = None, news: DataFrame | None = None, d1_kama: int = 50, rows: int | None = None) -> DataFrame:
    """All model features per bar.

    Three stages share the row chunks: all first-level recursions in one scan, the recursions on their results in a
    second one, then every bounded frame in one window pass. Order flow and news are joins; without them they are
    null and 0.5.
    """

    def dm(name, col):
        def make(d, w):
            d = I._dm(d, w)
            first = F.col("rn") == 1
            return d, F.when(first, 0.0).otherwise(1 - 1.0 / 14), F.when(first, F.col(col)).otherwise(F.col(col) / 14)

        return (name, 1, 0, make)

    parts = [I.kama_part(f"k{n}", n) for n in KAMAS] + I.rsi_parts("rsi_14", 14)
    parts += [I.atr_ml_part("atr_14", 14), I.atr_ml_part("atr_5", 5), I.atr_ml_part("atr_50", 50), dm("trs", "__tr"), dm("ps", "__dmp"), dm("ms", "__dmm")]
    s = I.finish_rsi(I.scan_parts(bars, parts, rows=rows), "rsi_14", 50.0)
    s = s.withColumn("di_plus_14", 100 * safe_div("ps", "trs")).withColumn("di_minus_14", 100 * safe_div("ms", "trs"))
    p, m = F.col("di_plus_14"), F.col("di_minus_14")
    s = settle(s.withColumn("dx", 100 * safe_div(F.abs(p - m), p + m)).withColumn("line", F.col("k12") - F.col("k26")))
    s = settle(I.scan_parts(s, [I.wilder_part("adx_14", "dx", 14), I.kama_part("sig", 9, "line", first_row=26)], rows=rows))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    s = running(s, {"__pv": ("sum", typical * F.col("tick_volume")), "__v": ("sum", F.col("tick_volume"))}, rows=rows)
    weights = {"fd_close_d03": N.frac_weights(0.3, 100)[::-1], "fd_close_d05": N.frac_weights(0.5, 100)[::-1]}

    def build(d, w):
        d = N.add_returns(d, w, (1, 5, 20, 50))
        f20 = N.last_rows(w, 20)
        d = d.withColumn("__lagged", F.lag("ret_1", 5).over(w)).withColumn("__sv", N.signed_volume(d, w))
        skew, kurt = N.moments_expr("ret_1", f20)
        full = F.col("rn") >= 21
        flat = F.stddev_pop("ret_1").over(N.last_rows(w, 50)) == 0
        auto = F.when(flat, 0.0).otherwise(correlation("ret_1", "__lagged", N.last_rows(w, 45)))
        lo, hi = F.min("tick_volume").over(f20), F.max("tick_volume").over(f20)
        old = F.lag("k9", 5).over(w)
        d = d.withColumn("__closes", F.collect_list("close").over(N.last_rows(w, 100)))
        d = d.withColumns({
            "volatility_20": F.when(full, F.stddev_samp("ret_1").over(f20)),
            "bb_width": N.when_full(safe_div(2 * F.stddev_samp("close").over(f20), F.avg("close").over(f20)), 20),
            "vol_ratio": N.when_full(safe_div("tick_volume", F.avg("tick_volume").over(f20)), 20),
            "skew_20": F.when(full, skew), "kurt_20": F.coalesce(F.when(full, kurt), F.lit(0.0)),
            "autocorr_5": N.when_full(auto, 51),
            "obv_slope_5": F.when(F.col("rn") > 5, F.sum("__sv").over(N.last_rows(w, 5)) / 5),
            "volume_rank_20": F.when(F.col("rn") >= 10, (F.col("tick_volume") - lo) / F.greatest(hi - lo, F.lit(TINY))).otherwise(0.5),
            "kama_slope_5": F.when(old.isNotNull(), (F.col("k9") - old) / F.greatest(old, F.lit(TINY))),
        })
        for name, ws in weights.items():
            dot = F.aggregate(F.zip_with("__closes", F.array(*[F.lit(x) for x in ws]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
            d = d.withColumn(name, F.when(F.col("rn") >= 100, dot / F.greatest("close", F.lit(TINY))).otherwise(0.0))
        return d.drop("__lagged", "__sv", "__closes")

    s = regime_ratios(settle(rolling(s, build, back=100, rows=rows)), rows)
    s = s.withColumns({
        **{f"kama{n}_ratio": safe_div("close", f"k{n}") for n in (4, 9, 21, 50, 100, 200)},
        "kama9_21_diff": safe_div(F.col("k9") - F.col("k21"), "close"), "macd": safe_div("line", "close"), "macd_signal": safe_div("sig", "close"),
        "macd_hist": safe_div(F.col("line") - F.col("sig"), "close"), "atr_ratio": safe_div("atr_14", "close"), "atr_ratio_5_14": safe_div("atr_5", "atr_14"),
        "atr_ratio_14_50": safe_div("atr_14", "atr_50"), "hl_range_ratio": safe_div(F.col("high") - F.col("low"), "atr_14"),
        "vwap_dist": safe_div(F.col("close") - safe_div("__pv", F.col("__v").cast("double")), "close"),
    }).drop("__pv", "__v", "dx", "line", "sig", "trs", "ps", "ms", *[f"k{n}" for n in KAMAS])
    s = P.interactions(P.session_flags(P.time_features(P.candle_shape(s))))
    s = multi_tf_features(settle(s), d1_kama, rows)
    if m1 is not None:
        s = m1_orderflow(s, m1)
    else:
        s = s.withColumns({c: F.lit(None).cast("double") for c in FEATURE_COLS if c.startswith("of_")})
    if news is None:
        return s.withColumn("news_score", F.lit(0.5))
    scores = news.select("symbol", ((F.col("score") + 1) / 2).alias("__news"))
    return s.join(scores, "symbol", "left").withColumn("news_score", F.coalesce("__news", F.lit(0.5))).drop("__news")


def prepared_features(bars: DataFrame, m1: DataFrame | None = None, d1_kama: int = 50, rows: int | None = None) -> DataFrame:
    return P.prepare_features(compute_features(bars, m1, d1_kama=d1_kama, rows=rows), FEATURE_COLS)
