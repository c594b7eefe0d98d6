"""Bounded frames and cumulative analytics over bars."""

from pyspark.sql import functions as F

from tidemark.operators import windows as N
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, sql

WIN = "WINDOW w AS (PARTITION BY symbol ORDER BY rn)"


def frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def key(df, *cols, digits=6):
    return rounded(df.select("symbol", "rn", *cols), digits)


RET1 = "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret_1 FROM bars"


@query("returns", sql("SELECT symbol, rn, " + ", ".join(f"round(close / lag(close, {k}) OVER w - 1, 6) AS ret_{k}" for k in (1, 5, 20, 50)) + f" FROM bars {WIN}"))
def _(t: Tables):
    return key(N.returns(t.bars()), "ret_1", "ret_5", "ret_20", "ret_50")


@query(
    "forward_returns",
    sql("SELECT symbol, rn, " + ", ".join(f"round((lead(close, {k}) OVER w - close) / close * CASE WHEN close < open THEN -1 ELSE 1 END, 6) AS fwd_{k}" for k in (12, 24, 48)) + f" FROM bars {WIN}"),
)
def _(t: Tables):
    s = t.bars().withColumn("signal", F.when(F.col("close") < F.col("open"), "sell").otherwise("buy"))
    return key(N.forward_returns(s), "fwd_12", "fwd_24", "fwd_48")


@query("relative_volume", sql(f"SELECT symbol, rn, round(CASE WHEN rn >= 20 THEN avg(tick_volume) {frame(20)} END, 6) AS vol_sma, round(CASE WHEN rn >= 20 THEN tick_volume / avg(tick_volume) {frame(20)} END, 6) AS vol_ratio FROM bars"))
def _(t: Tables):
    out = N.rel_volume(t.bars())
    return key(out.withColumn("vol_ratio", F.when(F.col("vol_sma").isNotNull(), F.col("vol_ratio"))), "vol_sma", "vol_ratio")


@query(
    "rolling_volatility",
    sql(f"SELECT symbol, rn, round(CASE WHEN rn >= 21 THEN stddev_samp(ret_1) {frame(20)} END, 6) AS volatility_20, round(CASE WHEN rn >= 20 THEN 2 * stddev_samp(close) {frame(20)} / greatest(avg(close) {frame(20)}, 1e-10) END, 6) AS bb_width FROM r1", r1=RET1),
)
def _(t: Tables):
    return key(N.rolling_vol(t.bars()), "volatility_20", "bb_width")


@query(
    "rolling_moments",
    sql(f"SELECT symbol, rn, round(CASE WHEN rn >= 21 THEN skewness(ret_1) {frame(20)} END, 6) AS skew_20, round(coalesce(CASE WHEN rn >= 21 THEN kurtosis(ret_1) {frame(20)} END, 0), 6) AS kurt_20 FROM r1", r1=RET1),
)
def _(t: Tables):
    return key(N.rolling_moments(t.bars()), "skew_20", "kurt_20")


@query(
    "rolling_autocorrelation",
    sql(
        f"SELECT symbol, rn, round(CASE WHEN rn >= 51 THEN corr(ret_1, lagged) {frame(45)} END, 6) AS autocorr_5 FROM lg",
        r1=RET1, lg="SELECT *, lag(ret_1, 5) OVER (PARTITION BY symbol ORDER BY rn) AS lagged FROM r1",
    ),
)
def _(t: Tables):
    return key(N.rolling_autocorr(t.bars()), "autocorr_5")


@query("volume_rank", sql(f"SELECT symbol, rn, round(CASE WHEN rn >= 10 THEN (tick_volume - min(tick_volume) {frame(20)}) / greatest(max(tick_volume) {frame(20)} - min(tick_volume) {frame(20)}, 1e-10) ELSE 0.5 END, 6) AS volume_rank_20 FROM bars"))
def _(t: Tables):
    return key(N.volume_rank(t.bars()), "volume_rank_20")


OBV = {
    "sv": "SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY rn)), 0) * tick_volume AS sv FROM bars",
    "ob": "SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS obv FROM sv",
}


@query("obv", sql(f"SELECT symbol, rn, CAST(obv AS BIGINT) AS obv, round((obv - lag(obv, 5) OVER w) / 5, 6) AS obv_slope_5 FROM ob {WIN}", **OBV))
def _(t: Tables):
    return key(N.obv(t.bars()), "obv", "obv_slope_5")


@query(
    "vwap",
    sql("SELECT symbol, rn, round(vw, 6) AS vwap, round((close - vw) / greatest(close, 1e-10), 4) AS vwap_dist FROM (SELECT *, sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w AS vw FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING))"),
)
def _(t: Tables):
    return N.vwap(t.bars()).select("symbol", "rn", F.round("vwap", 6).alias("vwap"), F.round("vwap_dist", 4).alias("vwap_dist"))


def _fd_sql(d: float, name: str) -> str:
    w = N.frac_weights(d, 100)
    return f"round(CASE WHEN rn >= 100 THEN list_dot_product(list(close) {frame(100)}, [{', '.join(repr(x) + '::DOUBLE' for x in w[::-1])}]) / greatest(close, 1e-10) ELSE 0 END, 5) AS {name}"


@query("fractional_difference", sql(f"SELECT symbol, rn, {_fd_sql(0.3, 'fd_close_d03')}, {_fd_sql(0.5, 'fd_close_d05')} FROM bars"))
def _(t: Tables):
    out = N.frac_diff(N.frac_diff(t.bars(), 0.3, name="fd_close_d03"), 0.5, name="fd_close_d05")
    return key(out, "fd_close_d03", "fd_close_d05", digits=5)


STEP = "SELECT *, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY rn)) AS step FROM bars"


@query(
    "efficiency_ratio",
    sql(
        f"""SELECT symbol, rn, round(CASE WHEN rn > 10 AND sum(step) {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(step) {frame(10)} ELSE 0 END, 6) AS er,
round(CASE WHEN rn > 10 AND sum(step) {frame(9)} > 0 THEN abs(close - lag(close, 9) OVER w) / sum(step) {frame(9)} ELSE 0 END, 6) AS er_legacy FROM st {WIN}""",
        st=STEP,
    ),
)
def _(t: Tables):
    out = N.efficiency_ratio(N.efficiency_ratio(t.bars(), legacy=True).withColumnRenamed("er", "er_legacy"))
    return key(out, "er", "er_legacy")


@query("true_range", sql(f"SELECT symbol, rn, round(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 6) AS tr FROM bars {WIN}"))
def _(t: Tables):
    return key(N.true_range(t.bars()), "tr")


@query("day_start", sql("SELECT symbol, rn, min(rn) OVER (PARTITION BY symbol, CAST(time AS DATE)) AS day_start FROM bars"))
def _(t: Tables):
    return N.day_start(t.bars()).select("symbol", "rn", "day_start")


F21 = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
DIVERGENCE = {
    **OBV,
    "ext": f"""SELECT *, min({{'v': close, 'at': rn, 'o': obv}}) {F21} AS lo, min({{'v': -close, 'at': rn, 'o': obv}}) {F21} AS hi, min(rn) {F21} AS frn FROM ob""",
    "dv": "SELECT *, rn >= 3 AND lo.at > frn AND obv > lo.o AS obv_div_buy, rn >= 3 AND hi.at > frn AND obv < hi.o AS obv_div_sell FROM ext",
}


@query("obv_divergence", sql("SELECT symbol, rn, obv_div_buy, obv_div_sell FROM dv", **DIVERGENCE))
def _(t: Tables):
    return N.obv_divergence(t.bars()).select("symbol", "rn", "obv_div_buy", "obv_div_sell")


VOLUME_FILTER = {
    **DIVERGENCE,
    "vf": f"SELECT symbol, rn, time, f OR obv_div_buy AS pass_buy, f OR obv_div_sell AS pass_sell FROM (SELECT *, rn < 25 OR avg(tick_volume) {frame(20)} <= 0 OR tick_volume / avg(tick_volume) {frame(20)} >= 1.2 AS f FROM dv)",
}


@query("volume_filter", sql("SELECT symbol, rn, pass_buy, pass_sell FROM vf", **VOLUME_FILTER))
def _(t: Tables):
    return N.volume_filter(t.bars()).select("symbol", "rn", "pass_buy", "pass_sell")


@query(
    "volume_filter_daily",
    sql("SELECT symbol, CAST(time AS DATE) AS day, count(*) AS bars, count(*) FILTER (pass_buy) AS pass_buy, count(*) FILTER (pass_sell) AS pass_sell FROM vf GROUP BY 1, 2", **VOLUME_FILTER),
)
def _(t: Tables):
    passed = N.volume_filter(t.bars())
    return passed.groupBy("symbol", F.to_date("time").alias("day")).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("pass_buy").alias("pass_buy"), F.count_if("pass_sell").alias("pass_sell")
    )


@query(
    "tail_event",
    sql(f"SELECT symbol, rn, coalesce(rn > 50 AND stddev_pop(ret_1) {frame(50)} > 0 AND abs(ret_1 - avg(ret_1) {frame(50)}) / stddev_pop(ret_1) {frame(50)} > 3, false) AS tail_event FROM r1", r1=RET1),
)
def _(t: Tables):
    return N.tail_event(t.bars()).select("symbol", "rn", "tail_event")


@query(
    "drawdown",
    sql("SELECT symbol, rn, round((pk - close) / greatest(pk, 1e-10) * 100, 6) AS dd_pct, (pk - close) / greatest(pk, 1e-10) * 100 >= 8 AS halt, (pk - close) / greatest(pk, 1e-10) * 100 >= 15 AS breaker FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pk FROM bars)"),
)
def _(t: Tables):
    return key(N.drawdown(t.bars(), "close"), "dd_pct", "halt", "breaker")


@query(
    "day_loss_limit",
    sql(
        """SELECT symbol, rn, day_pnl, round(loss, 6) AS loss_pct, eq <= 0 OR loss < 5 AS allowed FROM (SELECT *, CASE WHEN day_pnl < 0 AND eq > 0 THEN -day_pnl / eq * 100 ELSE 0 END AS loss FROM (
SELECT symbol, rn, CAST(sum(pnl) OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY rn ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS day_pnl,
CAST(sum(pnl) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS DOUBLE) + 1000000 AS eq FROM numbered))"""
    ),
)
def _(t: Tables):
    return key(N.day_loss(t.numbered_trades(), 1000000.0), "day_pnl", "loss_pct", "allowed")


@query(
    "cross_asset_features",
    sql(
        f"""SELECT symbol, rn, round(coalesce(close / greatest(ref, 1e-10), 1), 6) AS ratio, round(y0, 6) AS ref_ret,
round(CASE WHEN rn > 20 AND count(x) {frame(20)} >= 10 THEN coalesce(corr(x, y) {frame(20)}, 0) ELSE 0 END, 6) AS corr_20 FROM xy""",
        xr="SELECT b.*, r.close AS ref FROM bars b LEFT JOIN bars r ON r.symbol = 'click' AND r.time = b.time",
        xz=f"SELECT *, close / lag(close) OVER w - 1 AS x0, ref / lag(ref) OVER w - 1 AS y0 FROM xr {WIN}",
        xy="SELECT *, CASE WHEN x0 IS NOT NULL AND y0 IS NOT NULL THEN x0 END AS x, CASE WHEN x0 IS NOT NULL AND y0 IS NOT NULL THEN y0 END AS y FROM xz",
    ),
)
def _(t: Tables):
    return key(N.cross_asset_features(t.bars(), "click"), "ratio", "ref_ret", "corr_20")


@query(
    "feature_sequences",
    sql(f"SELECT symbol, rn, CASE WHEN rn >= 20 THEN len(list(close) {frame(20)}) END AS seq_len, round(CASE WHEN rn >= 20 THEN list_sum(list(close) {frame(20)}) END, 6) AS seq_close_sum, CASE WHEN rn >= 20 THEN lag(close, 19) OVER w END AS seq_first FROM bars {WIN}"),
)
def _(t: Tables):
    s = N.sequences(t.bars(), ["close", "tick_volume"])
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x["close"])
    known = F.col("sequence").isNotNull()
    return rounded(s.select("symbol", "rn", F.when(known, F.size("sequence").cast("long")).alias("seq_len"), total.alias("seq_close_sum"), F.when(known, F.col("sequence")[0]["close"]).alias("seq_first")))


@query(
    "pullback_checks",
    sql(
        f"""SELECT symbol, rn, rn <= 20 OR avg(tick_volume) {frame(20)} <= 0 OR tick_volume < avg(tick_volume) {frame(20)} * 0.8 AS pb_volume,
rn <= 5 OR low > min(low) {frame(6, '1 PRECEDING')} AS pb_structure_buy, rn <= 5 OR high < max(high) {frame(6, '1 PRECEDING')} AS pb_structure_sell FROM bars"""
    ),
)
def _(t: Tables):
    return N.pullback_checks(t.bars()).select("symbol", "rn", "pb_volume", "pb_structure_buy", "pb_structure_sell")
