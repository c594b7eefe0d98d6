"""Recursive indicators, checked against recursive common table expressions."""

from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.sqltext import Scan
from tidemark.plans.views import Tables, rec_cte, sql


def state(scan: Scan, cols: str, name: str = "r") -> str:
    return sql(f"SELECT symbol, rn, {cols} FROM {name} ORDER BY 1, 2", **scan.ctes(name))


def key(df, *cols):
    return rounded(df.select("symbol", "rn", *cols))


@query("ema", state(Scan().ema("ema_10", 10).ema("ema_40", 40), "round(ema_10, 6) AS ema_10, round(ema_40, 6) AS ema_40"))
def _(t: Tables):
    return key(I.scan_parts(t.bars(), [I.ema_part("ema_10", 10), I.ema_part("ema_40", 40)]), "ema_10", "ema_40")


@query("wilder_mean", state(Scan().wilder("wilder_14", "close", 14), "round(wilder_14, 6) AS wilder_14"))
def _(t: Tables):
    return key(I.scan_parts(t.bars(), [I.wilder_part("wilder_14", "close", 14)]), "wilder_14")


@query("kama", state(Scan().kama("kama_10", 10).kama("kama_50", 50), "round(kama_10, 6) AS kama_10, round(kama_50, 6) AS kama_50"))
def _(t: Tables):
    return key(I.scan_parts(t.bars(), [I.kama_part("kama_10", 10), I.kama_part("kama_50", 50)]), "kama_10", "kama_50")


@query("vidya", state(Scan().vidya("vidya_14", 14), "round(vidya_14, 6) AS vidya_14"))
def _(t: Tables):
    return key(I.scan_parts(t.bars(), [I.vidya_part("vidya_14", 14)]), "vidya_14")


@query(
    "moving_average_by_kind",
    state(Scan().kama("ma_kama", 20).vidya("ma_vidya", 20).ema("ma_other", 20), "round(ma_kama, 6) AS ma_kama, round(ma_vidya, 6) AS ma_vidya, round(ma_other, 6) AS ma_other"),
)
def _(t: Tables):
    return key(I.scan_parts(t.bars(), [I.ma_part(f"ma_{k}", 20, k) for k in ("kama", "vidya", "other")]), "ma_kama", "ma_vidya", "ma_other")


@query(
    "atr_variants",
    state(Scan().atr_series("atr_series", 14).atr_ml("atr_ml", 14).wilder("atr_base", "tr", 14), "round(atr_series, 6) AS atr_series, round(atr_ml, 6) AS atr_ml, round(atr_base, 6) AS atr_base"),
)
def _(t: Tables):
    parts = [I.atr_series_part("atr_series", 14), I.atr_ml_part("atr_ml", 14), I.atr_ewm_part("atr_base", 14)]
    return key(I.scan_parts(t.bars(), parts), "atr_series", "atr_ml", "atr_base")


RSI_EXPR = "CASE WHEN r_l = 0 THEN 100 ELSE 100 - 100 / (1 + r_g / r_l) END"


@query("rsi", state(Scan().rsi("r", 14), f"round({RSI_EXPR}, 6) AS rsi, round(coalesce({RSI_EXPR}, 50), 6) AS rsi_50"))
def _(t: Tables):
    out = I.rsi(t.bars(), 14)
    return key(out.withColumn("rsi_50", F.coalesce("rsi", F.lit(50.0))), "rsi", "rsi_50")


@query(
    "rsi_bounded",
    sql(
        """SELECT symbol, rn, round(CASE WHEN rn <= 44 THEN 50 WHEN l <= 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi_bounded FROM (SELECT symbol, rn,
  list_reduce(list_concat([list_sum(list_transform(c[1:14], lambda x: greatest(x, 0))) / 14], list_transform(c[2:15], lambda x: greatest(x, 0))), lambda a, x: (a * 13 + x) / 14) AS g,
  list_reduce(list_concat([list_sum(list_transform(c[1:14], lambda x: greatest(-x, 0))) / 14], list_transform(c[2:15], lambda x: greatest(-x, 0))), lambda a, x: (a * 13 + x) / 14) AS l
FROM (SELECT symbol, rn, list(close - pc) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS c
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM bars)))"""
    ),
)
def _(t: Tables):
    return key(I.rsi_bounded(t.bars(), 14), "rsi_bounded")


@query("adx_seeded", state(Scan().adx_seeded(14), "round(sadx, 6) AS adx"))
def _(t: Tables):
    return key(I.adx(t.bars(), 14), "adx")


@query(
    "adx_exponential",
    state(Scan().adx_ewm(14), "round(adx, 6) AS adx, round(100 * ps / greatest(trs, 1e-10), 6) AS adx_plus, round(100 * ms / greatest(trs, 1e-10), 6) AS adx_minus"),
)
def _(t: Tables):
    return key(I.adx_ewm(t.bars(), 14), "adx", "adx_plus", "adx_minus")


def macd_ctes() -> dict[str, str]:
    ctes = Scan().kama("k12", 12).kama("k26", 26).ctes("r")
    ctes["lines"] = "SELECT r.symbol, r.rn, close, k12 - k26 AS line FROM r JOIN bars USING (symbol, rn)"
    ctes["lsteps"] = "SELECT *, line - lag(line) OVER (PARTITION BY symbol ORDER BY rn) AS step FROM lines"
    ctes["lwide"] = """SELECT *, pow((CASE WHEN sum(abs(step)) OVER w9 > 0 THEN abs(line - lag(line, 9) OVER (PARTITION BY symbol ORDER BY rn)) / sum(abs(step)) OVER w9 ELSE 0 END)
  * (2.0::DOUBLE / 3.0 - 2.0::DOUBLE / 31.0) + 2.0::DOUBLE / 31.0, 2) AS sc FROM lsteps WINDOW w9 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"""
    ctes |= rec_cte("sg", "lwide", {"sig": "NULL"}, {"sig": "CASE WHEN b.rn < 34 THEN NULL WHEN b.rn = 34 THEN b.line ELSE p.sig + b.sc * (b.line - p.sig) END"})
    return ctes


@query(
    "macd_kama",
    sql(
        "SELECT symbol, rn, round(line / greatest(close, 1e-10), 6) AS macd, round(sig / greatest(close, 1e-10), 6) AS macd_signal, round((line - sig) / greatest(close, 1e-10), 6) AS macd_hist FROM lines JOIN sg USING (symbol, rn)",
        **macd_ctes(),
    ),
)
def _(t: Tables):
    return key(I.macd_kama(t.bars()), "macd", "macd_signal", "macd_hist")


KF = [4, 9, 21, 50, 100, 200]


def kama_scan() -> Scan:
    s = Scan()
    for n in KF:
        s.kama(f"k{n}", n)
    return s


@query(
    "kama_features",
    sql(
        "SELECT symbol, rn, "
        + ", ".join(f"round(CASE WHEN k{n} IS NOT NULL THEN close / greatest(k{n}, 1e-10) END, 6) AS kama{n}_ratio" for n in KF)
        + """, round((k9 - k21) / greatest(close, 1e-10), 6) AS kama9_21_diff,
  round(CASE WHEN lag(k9, 5) OVER w IS NOT NULL THEN (k9 - lag(k9, 5) OVER w) / greatest(lag(k9, 5) OVER w, 1e-10) END, 6) AS kama_slope_5
FROM r JOIN bars USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY rn)""",
        **kama_scan().ctes("r"),
    ),
)
def _(t: Tables):
    return key(I.kama_features(t.bars(), KF), *[f"kama{n}_ratio" for n in KF], "kama9_21_diff", "kama_slope_5")


@query(
    "atr_features",
    sql(
        """SELECT symbol, rn, round(a14, 6) AS atr_14, round(a14 / greatest(close, 1e-10), 6) AS atr_ratio, CASE WHEN a14 > 0 THEN round(a5 / greatest(a14, 1e-10), 4) ELSE round(a5 / 1e-10, -5) END AS atr_ratio_5_14,
  CASE WHEN a50 > 0 THEN round(a14 / greatest(a50, 1e-10), 4) ELSE round(a14 / 1e-10, -5) END AS atr_ratio_14_50, CASE WHEN a14 > 0 THEN round((high - low) / greatest(a14, 1e-10), 4) ELSE round((high - low) / 1e-10, -5) END AS hl_range_ratio FROM r JOIN bars USING (symbol, rn)""",
        **Scan().atr_ml("a14", 14).atr_ml("a5", 5).atr_ml("a50", 50).ctes("r"),
    ),
)
def _(t: Tables):
    out = I.atr_features(t.bars())
    # The first ATRs of a symbol are 0 and divide by the tiny floor: those ratios are compared to as many digits as the others.
    r4 = [F.when(F.col("rn") > n, F.round(c, 4)).otherwise(F.round(c, -5)).alias(c) for c, n in (("atr_ratio_5_14", 14), ("atr_ratio_14_50", 50), ("hl_range_ratio", 14))]
    return out.select("symbol", "rn", F.round("atr_14", 6).alias("atr_14"), F.round("atr_ratio", 6).alias("atr_ratio"), *r4)
