"""Signals, gates, labels, sizing and exits."""

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import projections as P
from tidemark.operators import resample as R
from tidemark.operators import signals as S
from tidemark.operators import sizing as Z
from tidemark.operators import windows as N
from tidemark.operators.chunks import rolling
from tidemark.operators import trailing as TR
from tidemark.operators.joins import align_labels, asof_join, bars_since_entry
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.sqltext import Scan
from tidemark.plans.trade_queries import QUOTES_SQL, quotes
from tidemark.plans.views import Tables, rec_cte, sql
from tidemark.plans.window_queries import VOLUME_FILTER, frame
from tidemark.session import settle

W = "WINDOW w AS (PARTITION BY symbol ORDER BY rn)"


def base(t: Tables):
    """Bars with fast and slow average, seeded ATR, RSI and seeded ADX."""
    parts = [I.kama_part("fast", 8), I.kama_part("slow", 24), I.atr_series_part("atr", 14), *I.rsi_parts("rsi", 14)]
    return settle(I.finish_rsi(I.scan_parts(t.bars(), parts), "rsi", 50.0))


def with_adx(t: Tables):
    return settle(I.adx(base(t), 14))


IND = Scan().kama("fast", 8).kama("slow", 24).atr_series("atr", 14).rsi("q", 14).adx_seeded(14).ctes("r")
IND["ind"] = f"""SELECT *, coalesce(CASE WHEN q_l = 0 THEN 100 ELSE 100 - 100 / (1 + q_g / q_l) END, 50) AS rsi, sadx AS adx,
  lag(fast) OVER w AS pf, lag(slow) OVER w AS ps, lag(close) OVER w AS pc FROM r_ind {W}"""
CROSS = "CASE WHEN pf <= ps AND fast > slow THEN 'buy' WHEN pf >= ps AND fast < slow THEN 'sell' END"


@query("crossover_signal", sql(f"SELECT symbol, rn, {CROSS} AS signal FROM ind", **IND))
def _(t: Tables):
    return S.crossover(base(t)).select("symbol", "rn", "signal")


STATE = """SELECT *, CASE WHEN pf IS NULL OR ps IS NULL OR fast IS NULL OR slow IS NULL THEN NULL WHEN fast > slow THEN 'buy' WHEN fast < slow THEN 'sell' END AS state_signal FROM ind"""


@query(
    "signal_state",
    sql(f"SELECT symbol, rn, state_signal AS signal, CASE WHEN state_signal IS NOT NULL THEN CASE WHEN ({CROSS}) IS NOT NULL THEN 'fresh' ELSE 'aligned' END END AS signal_type FROM stt", **IND, stt=STATE),
)
def _(t: Tables):
    return S.signal_state(base(t)).select("symbol", "rn", "signal", "signal_type")


PB = {
    **IND,
    "chk": f"""SELECT *, rn <= 20 OR avg(tick_volume) {frame(20)} <= 0 OR tick_volume < avg(tick_volume) {frame(20)} * 1.0 AS pb_v,
  rn <= 5 OR low > min(low) {frame(6, '1 PRECEDING')} AS pb_b, rn <= 5 OR high < max(high) {frame(6, '1 PRECEDING')} AS pb_s FROM ind""",
    "pbl": f"""SELECT *, atr > 0 AND rn > 3 AND abs(pc - pf) BETWEEN atr * 0.1 AND atr * 2.0 AND lag(pb_v) OVER w AS near, lag(pb_b) OVER w AS lb, lag(pb_s) OVER w AS ls, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM chk {W}""",
    "pbs": "SELECT symbol, rn, CASE WHEN near AND pf > ps AND lb AND close > ph THEN 'buy' WHEN near AND pf < ps AND ls AND close < pl THEN 'sell' END AS pb_signal FROM pbl",
}


@query("pullback_signal", sql("SELECT * FROM pbs", **PB))
def _(t: Tables):
    return S.pullback(settle(N.pullback_checks(base(t), threshold=1.0))).select("symbol", "rn", "pb_signal")


H4 = Scan("bars_h4").kama("h4_ma", 20).kama("h4_fast", 8).adx_ewm(14).ctes("hr")
HTF = {
    **IND,
    **H4,
    "hs": f"SELECT symbol, available_at, h4_ma AS htf_ma, close AS htf_close, h4_ma - lag(h4_ma, 12) OVER w AS htf_slope, adx AS h4_adx FROM hr_ind {W}",
    "hx": "SELECT i.*, h.htf_ma, h.htf_close, h.htf_slope, h.h4_adx FROM ind i ASOF LEFT JOIN hs h ON i.symbol = h.symbol AND i.time >= h.available_at",
}


def with_htf(t: Tables, bars):
    """Four-hour average, its slope, close and ADX as known at each bar's time."""
    h4 = I.scan_parts(t.htf("4 hours"), [I.kama_part("htf_ma", 20)])
    h4 = settle(I.adx_ewm(settle(h4), 14, "h4_adx", di=False))
    h4 = rolling(h4, lambda d, w: d.withColumn("htf_slope", F.col("htf_ma") - F.lag("htf_ma", 12).over(w)), back=12)
    h4 = h4.withColumn("htf_close", F.col("close"))
    return settle(asof_join(bars, h4, ["htf_ma", "htf_close", "htf_slope", "h4_adx"], right_on="available_at"))


@query(
    "mean_reversion_signal",
    sql("SELECT symbol, rn, CASE WHEN rsi < 40 AND coalesce(close > htf_ma * 0.9, true) THEN 'buy' WHEN rsi > 60 AND coalesce(close < htf_ma * 1.1, true) THEN 'sell' END AS mr_signal FROM hx", **HTF),
)
def _(t: Tables):
    return S.mean_reversion(with_htf(t, base(t)), 40, 60, 0.1).select("symbol", "rn", "mr_signal")


@query("mean_reversion_exit", sql(f"SELECT symbol, rn, coalesce(lag(rsi) OVER w < 50 AND rsi >= 50, false) AS exit_long, coalesce(lag(rsi) OVER w > 50 AND rsi <= 50, false) AS exit_short FROM ind {W}", **IND))
def _(t: Tables):
    return S.mr_exit(base(t)).select("symbol", "rn", "exit_long", "exit_short")


DEC = "CASE WHEN htf_ma IS NULL THEN 'soft' WHEN htf_close {o} htf_ma AND coalesce(htf_slope, 0) {o} 0 THEN 'allow' WHEN NOT htf_close {o} htf_ma AND NOT coalesce(htf_slope, 0) {o} 0 THEN 'block' ELSE 'soft' END"


@query("htf_trend", sql(f"SELECT symbol, rn, {DEC.format(o='>=')} AS htf_buy, {DEC.format(o='<=')} AS htf_sell, CAST(CASE {DEC.format(o='>=')} WHEN 'allow' THEN 1.0 WHEN 'block' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS htf_buy_mult FROM hx", **HTF))
def _(t: Tables):
    return S.htf_trend(with_htf(t, base(t))).select("symbol", "rn", "htf_buy", "htf_sell", "htf_buy_mult")


# Minute bars stand in for the quarter-hour frame.
M15 = {
    **HTF,
    "m15": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM (SELECT symbol, time_bucket(INTERVAL 15 MINUTES, time) AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(tick_volume) AS tick_volume FROM bars_m1 GROUP BY 1, 2)",
    **Scan("m15").ema("mf", 5).ema("ms", 12).ctes("mr"),
    "ma": "SELECT h.*, m.mf, m.ms FROM hx h ASOF LEFT JOIN (SELECT symbol, time + INTERVAL 15 MINUTES AS av, mf, ms FROM mr_ind) m ON h.symbol = m.symbol AND h.time >= m.av",
    "mx": f"SELECT *, lag(mf) OVER w AS pmf, lag(ms) OVER w AS pms, {CROSS} AS h1x FROM ma {W}",
    "mz": "SELECT *, CASE WHEN pmf <= pms AND mf > ms THEN 'buy' WHEN pmf >= pms AND mf < ms THEN 'sell' END AS mx15, CASE WHEN abs(close - htf_ma) > atr * 0.1 THEN CASE WHEN close > htf_ma THEN 'buy' ELSE 'sell' END END AS side FROM mx",
    "mq": "SELECT *, CASE WHEN rn > 2 AND atr > 0 AND h1x = side AND NOT (mx15 IS NOT NULL AND mx15 <> h1x) THEN h1x END AS sg FROM mz",
}


@query("mtf_signal", sql("SELECT symbol, rn, sg AS mtf_signal, CASE WHEN sg IS NOT NULL THEN CASE WHEN mx15 = h1x THEN 'crossover' ELSE 'pullback' END END AS mtf_type, CAST(CASE WHEN sg IS NULL THEN 0.0 WHEN mx15 = h1x THEN 1.0 ELSE 0.67 END AS DOUBLE) AS mtf_confidence FROM mq", **M15))
def _(t: Tables):
    from tidemark.functions.times import month_of
    from tidemark.operators.chunks import index_rows

    m15 = settle(index_rows(R.resample(t.bars_m1(), "15 minutes"), ["symbol"], [month_of("time")], ["time"]))
    m15 = settle(I.scan_parts(m15, [I.ema_part("m15_fast", 5), I.ema_part("m15_slow", 12)])).withColumn("av", F.col("time") + F.expr("INTERVAL 15 MINUTES"))
    h1 = settle(asof_join(with_htf(t, base(t)), m15, ["m15_fast", "m15_slow"], right_on="av"))
    return S.mtf_signal(h1.withColumn("h4_ma", F.col("htf_ma")), band=0.1).select("symbol", "rn", "mtf_signal", "mtf_type", "mtf_confidence")


REGIME = {
    **HTF,
    **Scan("bars_d1").adx_ewm(14).ctes("dr"),
    "dx1": "SELECT h.*, d.d1_adx FROM hx h ASOF LEFT JOIN (SELECT symbol, available_at, adx AS d1_adx FROM dr_ind) d ON h.symbol = d.symbol AND h.time >= d.available_at",
    "rg": f"""SELECT *, CASE WHEN adx IS NULL THEN 'uncertain' WHEN adx >= 26 AND coalesce(adx - lag(adx, 5) OVER w < -2, false) THEN 'exhaustion' WHEN adx >= 20 AND (coalesce(h4_adx >= 16, false) OR coalesce(d1_adx >= 16, false)) THEN 'strong_trend'
  WHEN adx >= 20 THEN 'weak_trend' WHEN adx <= 16 AND NOT (coalesce(h4_adx >= 16, false) OR coalesce(d1_adx >= 16, false)) THEN 'ranging' ELSE 'uncertain' END AS regime FROM dx1 {W}""",
}


def with_regime(t: Tables):
    d1 = settle(I.adx_ewm(t.htf("1 day"), 14, "d1_adx", di=False))
    both = settle(asof_join(with_htf(t, with_adx(t)), d1, ["d1_adx"], right_on="available_at"))
    return S.regime(both, trend=20, ranging=16, exhaustion=26)


@query("regime", sql("SELECT symbol, rn, regime FROM rg", **REGIME))
def _(t: Tables):
    return with_regime(t).select("symbol", "rn", "regime")


FUSED = {
    **IND,
    "fz": f"""SELECT *, CASE WHEN rn > 10 AND sum(st) {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(st) {frame(10)} ELSE 0 END AS er FROM (SELECT *, abs(close - pc) AS st FROM ind) {W}""",
    "fs": """SELECT *, CASE WHEN rn > 50 THEN 100.0 * (0.45::DOUBLE * CASE WHEN adx > 0 THEN least(1, adx / 50) ELSE 0 END + 0.35::DOUBLE * least(1, er) + 0.20::DOUBLE * CASE WHEN atr > 0 THEN least(1, abs(coalesce(fast - pf, 0)) / atr * 2) ELSE 0 END) END AS fused_score FROM fz""",
    "hy": f"""SELECT *, fused_score IS NOT NULL AND coalesce(last_value(CASE WHEN fused_score > 27.5 THEN true WHEN fused_score < 22.5 THEN false END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), false) AS gate_open FROM fs""",
}


def fused(t: Tables):
    return settle(S.fused_score(with_adx(t)))


@query("fused_score", sql("SELECT symbol, rn, round(fused_score, 6) AS fused_score FROM fs", **FUSED))
def _(t: Tables):
    return rounded(S.fused_score(with_adx(t)).select("symbol", "rn", "fused_score"))


@query("hysteresis_gate", sql("SELECT symbol, rn, gate_open FROM hy", **FUSED))
def _(t: Tables):
    return S.hysteresis(fused(t), threshold=25.0).select("symbol", "rn", "gate_open")


@query("ma_slope", sql(f"SELECT symbol, rn, round(fast - lag(fast, 3) OVER w, 6) AS ma_slope FROM ind {W}", **IND))
def _(t: Tables):
    return rounded(rolling(base(t), lambda d, w: d.withColumn("ma_slope", F.col("fast") - F.lag("fast", 3).over(w)), back=3).select("symbol", "rn", "ma_slope"))


_SC = """SELECT symbol, time, rn, CASE WHEN close >= open THEN 'buy' ELSE 'sell' END AS signal, least(close / 60, 1) AS ml, CASE WHEN tick_volume > 5 THEN NULL ELSE greatest(0, 1 - spread * 0.05::DOUBLE / 0.3::DOUBLE) END AS spread_s,
  (close - low) / greatest(high - low, 1e-10) AS news FROM bars"""
ESC = {
    "sc0": _SC,
    "es": """SELECT *, CASE WHEN signal = 'sell' THEN 1 - news ELSE news END AS nw FROM sc0""",
    "esc": "SELECT *, (ml * 0.4::DOUBLE + coalesce(spread_s * 0.3::DOUBLE, 0) + nw * 0.3::DOUBLE) / (0.4::DOUBLE + CASE WHEN spread_s IS NULL THEN 0 ELSE 0.3::DOUBLE END + 0.3::DOUBLE) AS score FROM es",
}


def scored_entries(t: Tables):
    side = F.when(F.col("close") >= F.col("open"), "buy").otherwise("sell")
    b = t.bars().withColumn("signal", side).withColumn("ml", F.least(F.col("close") / 60, F.lit(1.0)))
    b = b.withColumn("spread", F.when(F.col("tick_volume") <= 5, F.greatest(F.lit(0.0), 1 - F.col("spread") * 0.05 / 0.3)))
    return S.entry_score(b.withColumn("news", (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-10))))


@query("entry_score", sql("SELECT symbol, rn, signal, round(score, 6) AS entry_score FROM esc", **ESC))
def _(t: Tables):
    return rounded(scored_entries(t).select("symbol", "rn", "signal", "entry_score"))


@query(
    "confidence_bucket",
    sql("SELECT symbol, rn, score >= 0.6 AS score_ok, round(CASE WHEN score >= 0.6 THEN CASE WHEN nw >= 0.7 THEN least(1.5, b * 1.1) WHEN nw <= 0.3 THEN b * 0.5 ELSE b END ELSE 0 END, 6)::DOUBLE AS confidence_mult FROM (SELECT *, CASE WHEN score >= 0.85 THEN 1.0 WHEN score >= 0.6 THEN 0.85 ELSE 0.5 END AS b FROM esc)", **ESC),
)
def _(t: Tables):
    s = scored_entries(t).withColumn("news", F.when(F.col("signal") == "sell", 1 - F.col("news")).otherwise(F.col("news")))
    return rounded(S.confidence_bucket(s).select("symbol", "rn", "score_ok", "confidence_mult"))


@query(
    "execution_gate",
    sql(
        """SELECT v.symbol, v.rn, pass_buy AND spok AND NOT coalesce(bb, false) AS exec_buy, pass_sell AND spok AND NOT coalesce(bs, false) AS exec_sell FROM vf v JOIN (SELECT symbol, rn, CASE WHEN spread > 0 AND atr > 0 THEN spread * 1.0 / atr <= 0.03 ELSE true END AS spok FROM ind) s USING (symbol, rn)
LEFT JOIN tape p ON p.symbol = v.symbol AND p.time = v.time""",
        **VOLUME_FILTER,
        **IND,
        tape="""SELECT symbol, hour AS time, ok AND pressure < 0.35 AND ra > 1.0 AS bb, ok AND pressure > 0.65 AND ra > 1.0 AS bs FROM (SELECT symbol, hour, avg(cp) FILTER (k <= 5) AS pressure, avg(rng) FILTER (k <= 5) / (avg(rng) + 1e-10) AS ra, count(*) >= 2 AND avg(rng) > 0 AS ok
  FROM (SELECT symbol, date_trunc('hour', time) AS hour, high - low AS rng, (close - low) / (high - low + 1e-10) AS cp, row_number() OVER (PARTITION BY symbol, date_trunc('hour', time) ORDER BY time DESC) AS k FROM bars_m1) WHERE k <= 20 GROUP BY 1, 2)""",
    ),
)
def _(t: Tables):
    b = N.volume_filter(P.spread_filter(base(t), 1.0, 0.03))
    tape = R.tape_pressure(t.bars_m1(), min_bars=2, active=1.0).select("symbol", "time", "block_buy", "block_sell")
    return S.execution_gate(b.join(tape, ["symbol", "time"], "left")).select("symbol", "rn", "exec_buy", "exec_sell")


@query(
    "bias_freeze",
    sql(
        f"""SELECT symbol, rn, CAST(flips AS BIGINT) AS flips, flips < 2 AND coalesce(sg = 'buy', true) AS bias_buy, flips < 2 AND coalesce(sg = 'sell', true) AS bias_sell FROM (SELECT *, sum(CASE WHEN sg IS NOT NULL AND prev IS NOT NULL AND sg <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, d ORDER BY rn ROWS UNBOUNDED PRECEDING) AS flips FROM (
SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol, d ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT symbol, rn, CAST(time AS DATE) AS d, {CROSS} AS sg FROM ind)))""",
        **IND,
    ),
)
def _(t: Tables):
    return S.bias_freeze(S.crossover(base(t), name="bias_signal"), 2).select("symbol", "rn", "flips", "bias_buy", "bias_sell")


@query(
    "select_entry",
    sql(
        f"""SELECT symbol, rn, CASE WHEN NOT coalesce(kind = 'crossover' AND NOT gate_open, false) THEN chosen END AS entry, CASE WHEN NOT coalesce(kind = 'crossover' AND NOT gate_open, false) THEN kind END AS entry_type FROM (
SELECT symbol, rn, gate_open, coalesce(mr, sg, pb) AS chosen, CASE WHEN mr IS NOT NULL THEN 'mean_reversion' WHEN sg IS NOT NULL THEN 'crossover' WHEN pb IS NOT NULL THEN 'pullback' END AS kind FROM (
SELECT g.symbol, g.rn, h.gate_open, {CROSS} AS sg, CASE WHEN ({CROSS}) IS NULL AND regime IN ('strong_trend', 'weak_trend', 'uncertain') THEN pb_signal END AS pb,
CASE WHEN regime = 'ranging' THEN CASE WHEN rsi < 40 THEN 'buy' WHEN rsi > 60 THEN 'sell' END END AS mr FROM rg g JOIN pbs USING (symbol, rn) JOIN (SELECT symbol, rn, gate_open FROM hy) h USING (symbol, rn)))""",
        **{**REGIME, **PB, **FUSED},
    ),
)
def _(t: Tables):
    r = settle(with_regime(t))
    g = S.hysteresis(settle(S.fused_score(r)), threshold=25.0)
    p = S.pullback(settle(N.pullback_checks(g, threshold=1.0)))
    p = p.withColumn("mr_signal", F.when(F.col("rsi") < 40, "buy").when(F.col("rsi") > 60, "sell"))
    return S.select_entry(S.crossover(p)).select("symbol", "rn", "entry", "entry_type")


VM = f"CASE WHEN rn >= 63 AND atr / avg(atr) {frame(50)} > 1.2 THEN greatest(0.25, 1 / (atr / avg(atr) {frame(50)})) ELSE 1.0 END"


@query("volatility_mult", sql(f"SELECT symbol, rn, round({VM}, 6) AS vol_mult FROM ind", **IND))
def _(t: Tables):
    return rounded(S.volatility_mult(base(t)).select("symbol", "rn", "vol_mult"))


@query(
    "component_scores",
    sql(
        f"""SELECT symbol, rn, CASE WHEN fast IS NULL OR slow IS NULL THEN 0.5 WHEN coalesce(pf <= ps AND fast > slow, false) THEN 1.0 WHEN fast > slow THEN 0.7 ELSE 0.3 END::DOUBLE AS exec,
round(least(1, tick_volume / avg(tick_volume) {frame(20)} / 1.2), 6) AS volume, round(least(1, coalesce(atr / avg(atr) {frame(20)}, 1) / 0.5), 6) AS volatility,
round(greatest(0, least(1, 1 - spread / coalesce(atr, 0.001) / 0.3)), 6) AS spread_sc, 0.5::DOUBLE AS news, 0.5::DOUBLE AS ml, 1.0::DOUBLE AS tail_risk FROM ind""",
        **IND,
    ),
)
def _(t: Tables):
    return rounded(S.component_scores(base(t)).select("symbol", "rn", "exec", "volume", "volatility", "spread_sc", "news", "ml", "tail_risk"))


# --- labels -------------------------------------------------------------------------------------------------------

ATRML = Scan().atr_ml("atr_14", 14).ctes("a")
LABEL = {
    **ATRML,
    "fw": """SELECT b.symbol, b.rn, b.close, b.atr_14, min(f.rn) FILTER (f.high >= b.close + b.atr_14 * 2 OR f.low <= b.close - b.atr_14) AS hit, count(*) AS n, max_by(f.close, f.rn) AS last_close
  FROM a_ind b JOIN bars f ON f.symbol = b.symbol AND f.rn BETWEEN b.rn + 1 AND b.rn + 20 GROUP BY 1, 2, 3, 4""",
    "lb": """SELECT b.symbol, b.rn, CASE WHEN w.n = 20 AND b.atr_14 > 0 THEN CASE WHEN f.high >= b.close + b.atr_14 * 2 THEN 1 WHEN f.low <= b.close - b.atr_14 THEN -1 END END AS label,
  CASE WHEN w.n = 20 AND b.atr_14 > 0 THEN CASE WHEN f.high >= b.close + b.atr_14 * 2 THEN 2.0 WHEN f.low <= b.close - b.atr_14 THEN -1.0 ELSE (w.last_close - b.close) / greatest(b.atr_14, 1e-10) END END AS r_multiple
  FROM a_ind b LEFT JOIN fw w ON w.symbol = b.symbol AND w.rn = b.rn LEFT JOIN bars f ON f.symbol = w.symbol AND f.rn = w.hit""",
}


def atr_bars(t: Tables):
    return settle(I.scan_parts(t.bars(), [I.atr_ml_part("atr_14", 14)]))


@query("triple_barrier", sql("SELECT symbol, rn, label FROM lb", **LABEL))
def _(t: Tables):
    return L.triple_barrier(atr_bars(t)).select("symbol", "rn", "label")


@query("r_multiple", sql("SELECT symbol, rn, round(r_multiple, 6) AS r_multiple FROM lb", **LABEL))
def _(t: Tables):
    return rounded(L.r_multiple(atr_bars(t)).select("symbol", "rn", "r_multiple"))


@query("align_labels", sql("SELECT b.symbol, b.time, b.close, l.label FROM bars b JOIN lb l USING (symbol, rn) WHERE l.label IS NOT NULL AND l.label <> 0", **LABEL))
def _(t: Tables):
    return align_labels(t.bars_h1().select("symbol", "time", "close"), L.triple_barrier(atr_bars(t)))


OUTCOME = {
    **IND,
    "sg": f"SELECT symbol, rn, time, close, atr, {CROSS} AS signal FROM ind WHERE ({CROSS}) IS NOT NULL AND atr > 0",
    "so": "SELECT *, greatest(floor(atr * 1.5 / 0.01::DOUBLE), 1) AS slp, floor(greatest(floor(atr * 1.5 / 0.01::DOUBLE), 1) * 2) AS tpp, CASE WHEN signal = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sd FROM sg",
    "sv": "SELECT *, close - sd * slp * 0.01::DOUBLE AS sl, close + sd * tpp * 0.01::DOUBLE AS tp FROM so",
    "ft": """SELECT v.symbol, v.rn, min(b.rn) AS touch_rn, min_by(CASE WHEN v.signal = 'buy' THEN b.low <= v.sl ELSE b.high >= v.sl END, b.rn) AS is_sl FROM sv v JOIN bars b ON b.symbol = v.symbol AND b.rn > v.rn AND b.rn <= v.rn + 399
  WHERE CASE WHEN v.signal = 'buy' THEN b.low <= v.sl OR b.high >= v.tp ELSE b.high >= v.sl OR b.low <= v.tp END GROUP BY 1, 2""",
}


def cross_signals(t: Tables):
    b = base(t)
    return b, settle(S.crossover(b).where(F.col("signal").isNotNull() & (F.col("atr") > 0)))


@query("signal_outcome", sql("SELECT v.symbol, v.rn, v.signal, f.touch_rn, CAST(CASE WHEN f.rn IS NULL THEN 0.0 WHEN is_sl THEN -1.0 ELSE 2.0 END AS DOUBLE) AS r FROM sv v LEFT JOIN ft f USING (symbol, rn)", **OUTCOME))
def _(t: Tables):
    bars, sig = cross_signals(t)
    return L.signal_outcome(sig, bars, 1.5, 2.0).select("symbol", "rn", "signal", "touch_rn", "r")


# The loop itself as a recursive walk: one position, checked bar by bar.
_SG = f"CASE WHEN ({CROSS}) = 'buy' THEN 1 WHEN ({CROSS}) = 'sell' THEN -1 ELSE 0 END"
_HIT = """(CASE WHEN p.side = 0 THEN 0 WHEN (p.side = 1 AND b.low <= p.sl) OR (p.side = -1 AND b.high >= p.sl) THEN 1
  WHEN (p.side = 1 AND b.high >= p.tp) OR (p.side = -1 AND b.low <= p.tp) THEN 2 WHEN b.sg <> 0 AND b.sg <> p.side THEN 3 ELSE 0 END)"""
_ENTER = f"({_HIT} = 3 OR p.side = 0) AND b.sg <> 0"
WALK = {
    **IND,
    "wk": f"SELECT symbol, rn, high, low, close, atr, CASE WHEN atr > 0 THEN {_SG} ELSE 0 END AS sg FROM ind",
    **rec_cte(
        "walk", "wk",
        {"side": "0", "erow": "0", "e": "0", "sl": "0", "tp": "0", "xrow": "0", "code": "0", "xprice": "0", "xentry": "0", "xside": "0"},
        {
            "side": f"CASE WHEN {_HIT} IN (1, 2) THEN 0 WHEN {_ENTER} THEN b.sg ELSE p.side END",
            "erow": f"CASE WHEN {_ENTER} THEN b.rn ELSE p.erow END",
            "e": f"CASE WHEN {_ENTER} THEN b.close ELSE p.e END",
            "sl": f"CASE WHEN {_ENTER} THEN b.close - b.sg * b.atr * 1.5::DOUBLE ELSE p.sl END",
            "tp": f"CASE WHEN {_ENTER} THEN b.close + b.sg * b.atr * 3.0::DOUBLE ELSE p.tp END",
            "xrow": "p.erow", "code": _HIT, "xprice": f"CASE {_HIT} WHEN 1 THEN p.sl WHEN 2 THEN p.tp ELSE b.close END", "xentry": "p.e", "xside": "p.side",
        },
    ),
    "lastbar": "SELECT symbol, max(rn) AS n FROM bars GROUP BY 1",
    "xs": """SELECT symbol, xside AS side, xrow AS entry_rn, rn AS exit_rn, xentry AS entry, xprice AS exit, code FROM walk WHERE code > 0
  UNION ALL SELECT w.symbol, side, erow, w.rn, e, b.close, 4 FROM walk w JOIN lastbar l ON l.symbol = w.symbol AND l.n = w.rn JOIN bars b ON b.symbol = w.symbol AND b.rn = w.rn WHERE side <> 0 AND erow < w.rn""",
}


@query(
    "non_overlapping_trades",
    sql(
        """SELECT symbol, CASE WHEN side = 1 THEN 'buy' ELSE 'sell' END AS type, CAST(entry_rn AS BIGINT) AS entry_rn, CAST(exit_rn AS BIGINT) AS exit_rn, entry, round(exit, 6) AS exit,
['SL', 'TP', 'REVERSE', 'END'][CAST(code AS INTEGER)] AS exit_reason, round((exit - entry) * side, 6) AS pnl FROM xs""",
        **WALK,
    ),
)
def _(t: Tables):
    bars, sig = cross_signals(t)
    side = F.when(F.col("signal") == "buy", 1.0).otherwise(-1.0)
    s = sig.withColumns({"param_id": F.lit(1), "sl": F.col("close") - side * F.col("atr") * 1.5, "tp": F.col("close") + side * F.col("atr") * 3.0})
    out = L.non_overlapping_trades(s.select("symbol", "param_id", "rn", "signal", "close", "sl", "tp"), bars)
    return rounded(out.select("symbol", "type", "entry_rn", "exit_rn", "entry", "exit", "exit_reason", "pnl"))


# --- sizing and exits ---------------------------------------------------------------------------------------------


@query(
    "stop_levels",
    sql("SELECT symbol, rn, CAST(slp AS BIGINT) AS sl_points, CAST(tpp AS BIGINT) AS tp_points, round(close - sd * slp * 0.01, 6) AS sl, round(close + sd * tpp * 0.01, 6) AS tp FROM (SELECT *, floor(slp * 2.0) AS tpp FROM (SELECT *, greatest(floor(atr * 1.5 / 0.01::DOUBLE), 50) AS slp, CASE WHEN signal = 'buy' THEN 1 ELSE -1 END AS sd FROM sg))", **OUTCOME),
)
def _(t: Tables):
    _, sig = cross_signals(t)
    out = Z.stop_levels(sig.withColumn("entry_type", F.lit("crossover")), 1.5, 2.0)
    return rounded(out.select("symbol", "rn", "sl_points", "tp_points", "sl", "tp"))


@query(
    "position_size",
    sql("""SELECT symbol, rn, round(sv, 6) AS sl_value, round(CASE WHEN (raw < 0.01 AND 0.01 * sv / 1000 > 2) OR lots * sv > 1500 THEN 0 ELSE lots END, 6) AS lots FROM (
SELECT *, least(greatest(round_even(raw / 0.01, 0) * 0.01, 0.01), 100.0) AS lots FROM (SELECT symbol, rn, floor(close * 20) * point / tick_size * tick_value AS sv, 1000 / greatest(floor(close * 20) * point / tick_size * tick_value, 1e-10) AS raw FROM bars JOIN event_meta USING (symbol) WHERE floor(close * 20) > 0))"""),
)
def _(t: Tables):
    b = t.bars().withColumn("sl_points", F.floor(F.col("close") * 20)).where(F.col("sl_points") > 0).join(t.event_meta(), "symbol")
    return rounded(Z.position_size(b, 100000.0).select("symbol", "rn", "sl_value", "lots"))


SIZE = """SELECT symbol, rn, CASE WHEN tick_volume > 7 THEN 0.5::DOUBLE WHEN close > 80 THEN 1.0::DOUBLE WHEN close > 40 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END * least(close / 50, 1.5::DOUBLE) * (0.5::DOUBLE + tick_volume / 20.0::DOUBLE) AS m FROM bars"""


@query("size_multiplier", sql("SELECT symbol, rn, round(m, 9) AS size_mult FROM sz", sz=SIZE))
def _(t: Tables):
    return rounded(_sized(t).select("symbol", "rn", "size_mult"), 9)


def _sized(t: Tables):
    b = t.bars().withColumns({
        "entry_type": F.when(F.col("tick_volume") > 7, "mean_reversion").otherwise("crossover"),
        "regime": F.when(F.col("close") > 80, "strong_trend").when(F.col("close") > 40, "uncertain").otherwise("weak_trend"),
        "kelly_mult": F.least(F.col("close") / 50, F.lit(1.5)), "confidence_mult": 0.5 + F.col("tick_volume") / 20.0,
    })
    return Z.size_multiplier(b)


@query("budget_scale", sql("SELECT symbol, rn, round(least(greatest(CASE WHEN 2500 + m * 1000 > 3000 THEN m * 3000 / greatest(2500 + m * 1000, 1) ELSE m END, 0.25), 1.5), 9) AS size_mult FROM sz", sz=SIZE))
def _(t: Tables):
    return rounded(Z.budget_scale(_sized(t), 100000.0, 2500.0).select("symbol", "rn", "size_mult"), 9)


# Bars with ATR and the acceleration factor from the fast average and its value five bars before; positions with the row of
# the last such bar before their entry.
HELD = {
    **IND,
    "ab": """SELECT symbol, rn, time, high, low, close, atr, CASE WHEN ratio IS NULL THEN 1 ELSE greatest(0.5::DOUBLE, least(1.5::DOUBLE, CASE WHEN ratio > 1 THEN 1 - 0.2::DOUBLE * least(ratio - 1, 1) ELSE 1 + 0.2::DOUBLE * least(1 - ratio, 1) END)) END AS accel
FROM (SELECT *, fast / greatest(lag(fast, 5) OVER (PARTITION BY symbol ORDER BY rn), 1e-10) AS ratio FROM ind) WHERE atr IS NOT NULL""",
    "ps": """SELECT p.*, CASE WHEN type = 'buy' THEN 1 ELSE -1 END AS sd, coalesce((SELECT max(x.rn) FROM ab x WHERE x.symbol = p.symbol AND x.time < p.time), (SELECT min(x.rn) FROM ab x WHERE x.symbol = p.symbol)) AS start_rn,
  (SELECT max(x.rn) FROM ab x WHERE x.symbol = p.symbol) AS end_rn FROM positions p WHERE symbol IN (SELECT symbol FROM ab)""",
}
#: The stop of a position at each bar, from rows of hb with its partial-close level; `own` names a position, `staged` the multiple before a partial close.
_PW = "(PARTITION BY {own} ORDER BY rn ROWS UNBOUNDED PRECEDING)"


def trailing_sql(own: str, staged: str, partial: str) -> dict[str, str]:
    pw = _PW.format(own=own)
    return {
        "hp": f"SELECT *, coalesce(max(bar_time > time AND CASE WHEN type = 'buy' THEN high >= lvl ELSE low <= lvl END) OVER {pw}, false) AS partial FROM hb",
        "hm": f"SELECT *, CASE WHEN partial THEN {partial} ELSE {staged} END * accel AS m FROM hp",
        "hr": f"SELECT *, max(CASE WHEN type = 'buy' THEN high ELSE -low END) OVER {pw} - atr * m AS raw, max(CASE WHEN type = 'buy' THEN high ELSE -low END) OVER {pw} AS peak FROM hm",
        "hs": f"SELECT *, sd * greatest(max(raw) OVER {pw}, sl * sd) AS stop FROM hr",
        "hx": "SELECT *, CASE WHEN type = 'buy' THEN low <= stop ELSE high >= stop END AS breached FROM hs",
    }


HELD_BARS = "SELECT p.*, b.rn, b.time AS bar_time, b.high, b.low, b.close, b.atr, b.accel, price_open + sd * abs(price_open - sl) * 2 * 0.5 AS lvl FROM ps p JOIN ab b ON b.symbol = p.symbol AND b.rn >= p.start_rn"
STAGED = "CASE WHEN (close - price_open) * sd / greatest(abs(price_open - sl), 1e-10) >= 3 THEN 1.5::DOUBLE ELSE 3.5::DOUBLE END"


def held_bars(t: Tables):
    """Bars with atr and accel, and positions with start_rn and end_rn."""
    b = rolling(base(t), lambda d, w: d.withColumn("accel", TR.acceleration(F.col("fast") / F.greatest(F.lag("fast", 5).over(w), F.lit(1e-10)))), back=5)
    bars = settle(b.where(F.col("atr").isNotNull()).select("symbol", "rn", "time", "high", "low", "close", "atr", "accel"))
    return bars, settle(TR.with_start(t.positions(), bars))


@query(
    "chandelier_stop",
    sql("SELECT symbol, day_no, bar_time, round(stop, 6) AS stop, partial, breached FROM hx", **HELD, hb=HELD_BARS, **trailing_sql("symbol, day_no", STAGED, "1.5::DOUBLE")),
)
def _(t: Tables):
    bars, _ = held_bars(t)
    more = bars.select("symbol", F.col("time").alias("bar_time"), "atr", "accel")
    held = bars_since_entry(t.positions(), bars).join(more, ["symbol", "bar_time"])
    out = Z.chandelier(held, TR.stop_mult(F.col("close"), F.col("partial"), F.col("accel")), TR.partial_level(0.5))
    return rounded(out.select("symbol", "day_no", "bar_time", "stop", "partial", "breached"))


@query(
    "chandelier_exit",
    sql(
        """SELECT p.symbol, p.day_no, x.rn AS exit_rn, x.bar_time AS exit_time, round(x.stop, 6) AS exit_stop, CASE WHEN x.rn IS NULL OR l.at < x.bar_time THEN l.at END AS partial_time,
  round(coalesce(x.peak, e.peak) * p.sd, 6) AS extreme, round(coalesce(x.stop, e.stop), 6) AS stop
FROM ps p LEFT JOIN (SELECT symbol, day_no, min(rn) AS rn, min_by(bar_time, rn) AS bar_time, min_by(stop, rn) AS stop, min_by(peak, rn) AS peak FROM hx WHERE breached AND bar_time > time GROUP BY 1, 2) x USING (symbol, day_no)
LEFT JOIN (SELECT symbol, day_no, max_by(peak, rn) AS peak, max_by(stop, rn) AS stop FROM hx GROUP BY 1, 2) e USING (symbol, day_no) LEFT JOIN (SELECT symbol, day_no, min(bar_time) AS at FROM hx WHERE partial GROUP BY 1, 2) l USING (symbol, day_no)""",
        **HELD, hb=HELD_BARS, **trailing_sql("symbol, day_no", STAGED, "1.5::DOUBLE"),
    ),
)
def _(t: Tables):
    """Where each position's trailing stop takes it out."""
    bars, p = held_bars(t)
    out = TR.trail(p, bars, TR.stop_mult(F.col("close"), F.col("partial"), F.col("accel")), ["symbol", "day_no"], TR.partial_level(0.5))
    return rounded(out.select("symbol", "day_no", "exit_rn", "exit_time", "exit_stop", "partial_time", "extreme", "stop"))


@query(
    "extreme_since_entry",
    sql("SELECT p.symbol, p.day_no, p.start_rn, k AS bars, max(b.high) AS highest, min(b.low) AS lowest FROM ps p, (VALUES (20), (300), (1000000)) v(k), ab b WHERE b.symbol = p.symbol AND b.rn >= p.start_rn AND b.rn <= least(p.start_rn + k - 1, p.end_rn) GROUP BY ALL", **HELD),
)
def _(t: Tables):
    """Highest and lowest price of each position over its first 20 and 300 bars and up to the last one."""
    bars, p = held_bars(t)
    asked = p.withColumn("bars", F.explode(F.array(F.lit(20), F.lit(300), F.lit(1000000)))).select("symbol", "day_no", "start_rn", "bars", F.col("start_rn").alias("from_rn"), F.least(F.col("start_rn") + F.col("bars") - 1, F.col("end_rn")).alias("to_rn"))
    return TR.extreme_between(asked, bars, 32).drop("from_rn", "to_rn")


@query(
    "scale_out_levels",
    sql("""SELECT symbol, day_no, CAST(step AS INTEGER) AS step, round(price_open + sd * dist * [0.5, 0.75][step + 1], 6) AS level, round(greatest(floor(volume * [0.2, 0.2][step + 1] / 0.01 + 1e-9) * 0.01, 0.01), 6) AS close_volume,
round(price_open + sd * dist * CASE WHEN step = 0 THEN 0.25 ELSE 0.5 END, 6) AS new_sl FROM (SELECT *, CASE WHEN type = 'buy' THEN 1 ELSE -1 END AS sd, abs(price_open - sl) * 2 AS dist FROM positions), (VALUES (0), (1)) s(step)"""),
)
def _(t: Tables):
    return rounded(Z.scale_out_levels(t.positions(), [0.5, 0.75], [0.2, 0.2]).select("symbol", "day_no", "step", "level", "close_volume", "new_sl"))


@query("breakeven", sql("SELECT symbol, day_no, round(pr / atr_entry, 6) AS profit_atrs, pr > 0 AND pr / atr_entry >= 1 AND (sl - price_open) * sd < 0 AS to_breakeven FROM (SELECT *, (price_current - price_open) * sd AS pr FROM (SELECT p.*, q.price_current, CASE WHEN type = 'buy' THEN 1 ELSE -1 END AS sd FROM positions p JOIN q USING (symbol)))", q=QUOTES_SQL))
def _(t: Tables):
    return rounded(Z.breakeven(t.positions(), quotes(t)).select("symbol", "day_no", "profit_atrs", "to_breakeven"))


@query("max_hold", sql("SELECT symbol, day_no, round((epoch(TIMESTAMP '2024-01-28 06:00:00') - epoch(time)) / 3600.0, 6) AS held_hours, (epoch(TIMESTAMP '2024-01-28 06:00:00') - epoch(time)) / 3600.0 >= 72 AS expired FROM positions"))
def _(t: Tables):
    return rounded(Z.max_hold(t.positions(), F.lit("2024-01-28 06:00:00").cast("timestamp_ntz")).select("symbol", "day_no", "held_hours", "expired"))


@query(
    "reversal_exit",
    sql(
        f"SELECT p.symbol, p.day_no, coalesce(s.signal <> p.type, false) AND NOT coalesce(s.atr > 0 AND (s.close - p.price_open) * CASE WHEN p.type = 'buy' THEN 1 ELSE -1 END > s.atr * 0.25, false) AS reverse FROM positions p JOIN (SELECT symbol, signal, close, atr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS k FROM sg) WHERE k = 1) s USING (symbol)",
        **OUTCOME,
    ),
)
def _(t: Tables):
    _, sig = cross_signals(t)
    latest = sig.groupBy("symbol").agg(F.max_by(F.struct("signal", "close", "atr"), "rn").alias("s")).select("symbol", "s.*")
    return Z.reversal_exit(t.positions(), latest).select("symbol", "day_no", "reverse")


# --- features -----------------------------------------------------------------------------------------------------

REGR = {
    **Scan().atr_ml("atr_14", 14).adx_ewm(14).ctes("g"),
    "rr": f"""SELECT symbol, rn, CASE WHEN m > 0 THEN round(atr_14 / greatest(m, 1e-10), 4) WHEN m IS NOT NULL THEN round(atr_14 / greatest(m, 1e-10), -5) END AS atr_sma_ratio,
  CASE WHEN atr_14 > 0 THEN round((close - hi) / greatest(atr_14, 1e-10), 4) ELSE round((close - hi) / 1e-10, -5) END AS dist_swing_high_20,
  CASE WHEN atr_14 > 0 THEN round((close - lo) / greatest(atr_14, 1e-10), 4) ELSE round((close - lo) / 1e-10, -5) END AS dist_swing_low_20, round(slope, 6) AS adx_slope_5 FROM (
SELECT *, CASE WHEN rn >= 14 THEN avg(atr_14) {frame(50)} END AS m, CASE WHEN rn > 5 THEN max(high) {frame(21, '1 PRECEDING')} END AS hi, CASE WHEN rn > 5 THEN min(low) {frame(21, '1 PRECEDING')} END AS lo, (adx - lag(adx, 5) OVER w) / 5 AS slope FROM g_ind {W})""",
}


@query("regime_ratios", sql("SELECT * FROM rr", **REGR))
def _(t: Tables):
    b = I.scan_parts(t.bars(), [I.atr_ml_part("atr_14", 14)])
    b = settle(I.adx_ewm(settle(b), 14, "adx_14"))
    out = X.regime_ratios(b)
    # The first ATRs of a symbol are 0 and divide by the tiny floor: those ratios are compared to as many digits as the others.
    r4 = [F.when(F.col("rn") > 14, F.round(c, 4)).otherwise(F.round(c, -5)).alias(c) for c in ("atr_sma_ratio", "dist_swing_high_20", "dist_swing_low_20")]
    return out.select("symbol", "rn", *r4, F.round("adx_slope_5", 6).alias("adx_slope_5"))


@query(
    "multi_tf_features",
    sql(
        """SELECT b.symbol, b.rn, round(d.k, 6) AS d1_kama_ratio, round(d.adx, 6) AS d1_adx, round(d.r5, 6) AS d1_ret_5pct, round(d.r20, 6) AS d1_ret_20pct, round(h.adx, 6) AS h4_adx FROM bars b
LEFT JOIN dp d ON d.symbol = b.symbol AND d.time = date_trunc('day', b.time) LEFT JOIN hp h ON h.symbol = b.symbol AND h.time = time_bucket(INTERVAL 4 HOURS, b.time, TIMESTAMP '2000-01-01')""",
        **Scan("bars_d1").adx_ewm(14).kama("dk", 10).ctes("dd"),
        dv=f"SELECT *, CASE WHEN dk IS NOT NULL THEN close / greatest(dk, 1e-10) END AS k0, close / lag(close, 5) OVER w - 1 AS r50, close / lag(close, 20) OVER w - 1 AS r200 FROM dd_ind {W}",
        dp=f"SELECT symbol, time, lag(k0) OVER w AS k, lag(adx) OVER w AS adx, lag(r50) OVER w AS r5, lag(r200) OVER w AS r20 FROM dv {W}",
        **Scan("bars_h4").adx_ewm(14).ctes("hh"),
        hp=f"SELECT symbol, time, lag(adx) OVER w AS adx FROM hh_ind {W}",
    ),
)
def _(t: Tables):
    out = X.multi_tf_features(t.bars(), 10)
    return rounded(out.select("symbol", "rn", "d1_kama_ratio", "d1_adx", "d1_ret_5pct", "d1_ret_20pct", "h4_adx"))


@query(
    "feature_interactions",
    sql(
        f"""SELECT symbol, rn, round(ret_5 * CASE WHEN rn >= 21 THEN stddev_samp(ret_1) {frame(20)} END, 6) AS ret_5_x_vol_20, round(CASE WHEN rn >= 20 THEN tick_volume / avg(tick_volume) {frame(20)} END * ret_1, 6) AS vol_ratio_x_ret_1,
round(ret_1 * adx, 4) AS ret_1_x_adx FROM (SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5 FROM g_ind {W})""",
        **Scan().adx_ewm(14).ctes("g"),
    ),
)
def _(t: Tables):
    f = rolling(settle(I.adx_ewm(t.bars(), 14, "adx_14")), lambda d, w: N.add_returns(d, w, (1, 5)), back=5)
    f = P.interactions(N.rel_volume(N.rolling_vol(f)))
    return f.select("symbol", "rn", *[F.round(c, d).alias(c) for c, d in (("ret_5_x_vol_20", 6), ("vol_ratio_x_ret_1", 6), ("ret_1_x_adx", 4))])


@query("prepared_feature_table")
def _(t: Tables):
    return rounded(X.prepared_features(t.bars(), t.bars_m1(), d1_kama=10).select("symbol", "time", "rn", *X.FEATURE_COLS))
