"""Projections, filters, rule checks and scalar helpers."""

from pyspark.sql import functions as F

from tidemark.functions import numbers as M
from tidemark.functions import times as D
from tidemark.operators import projections as P
from tidemark.plans.flow_queries import rounded

from tidemark.plans.registry import query
from tidemark.plans.sqltext import Scan
from tidemark.plans.views import Tables, sql

CLASSES = {"click": "crypto", "view": "forex", "purchase": "commodity", "signup": "index"}
CLASS_SQL = "CASE symbol WHEN 'click' THEN 'crypto' WHEN 'view' THEN 'forex' WHEN 'purchase' THEN 'commodity' WHEN 'signup' THEN 'index' END"


@query("asset_class", sql(f"SELECT symbol, time, {CLASS_SQL} AS asset_class FROM bars"))
def _(t: Tables):
    return P.with_asset_class(t.bars_h1().select("symbol", "time"), CLASSES)


RULES = (("FOREX", ["RED", "BLUE"]), ("INDICES", ["SMALL"]), ("CRYPTO", ["RING", "GEAR"]), ("COMMOD", ["HOT"]))


@query(
    "classify_symbol",
    sql("""SELECT p_partkey, p_name, CASE WHEN regexp_matches(upper(p_name), 'RED|BLUE') THEN 'FOREX' WHEN contains(upper(p_name), 'SMALL') THEN 'INDICES'
WHEN regexp_matches(upper(p_name), 'RING|GEAR') THEN 'CRYPTO' WHEN contains(upper(p_name), 'HOT') THEN 'COMMOD' ELSE 'STOCKS' END AS category FROM part"""),
)
def _(t: Tables):
    return t.read("part").select("p_partkey", "p_name", P.classify_symbol("p_name", RULES).alias("category"))


@query("session_flags", sql("SELECT symbol, time, CAST(h >= 8 AND h < 17 AS DOUBLE) AS is_london, CAST(h >= 13 AND h < 22 AS DOUBLE) AS is_ny, CAST(h >= 13 AND h < 17 AS DOUBLE) AS is_overlap, CAST(h < 9 AS DOUBLE) AS is_asian FROM (SELECT *, hour(time) AS h FROM bars)"))
def _(t: Tables):
    return P.session_flags(t.bars_h1().select("symbol", "time"))


@query("session_gate", sql("SELECT mode, symbol, time, CASE mode WHEN 'only' THEN hour(time) BETWEEN 13 AND 22 WHEN 'overlap' THEN hour(time) BETWEEN 12 AND 17 ELSE NOT hour(time) BETWEEN 5 AND 12 END AS session_ok FROM bars, (VALUES ('only'), ('overlap'), ('asian')) m(mode)"))
def _(t: Tables):
    b = t.bars_h1().select("symbol", "time")
    one = lambda mode, **kw: P.session_gate(b, **kw).select(F.lit(mode).alias("mode"), "symbol", "time", "session_ok")
    return one("only", only_session=True).unionByName(one("overlap", require_overlap=True)).unionByName(one("asian", skip_asian=True))


@query(
    "time_features",
    sql("SELECT symbol, time, round(sin(2 * pi() * hour(time) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(time) / 24), 6) + 0 AS hour_cos, round(sin(2 * pi() * (isodow(time) - 1) / 7), 6) + 0 AS day_sin, round(cos(2 * pi() * (isodow(time) - 1) / 7), 6) + 0 AS day_cos FROM bars"),
)
def _(t: Tables):
    out = P.time_features(t.bars_h1().select("symbol", "time"))
    return out.select("symbol", "time", *[(F.round(c, 6) + F.lit(0)).alias(c) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")])


@query(
    "candle_shape",
    sql("""SELECT symbol, time, round((close - low) / r, 6) AS close_position, round(abs(close - open) / r, 6) AS body_ratio, round((high - greatest(close, open)) / r, 6) AS upper_wick, round((least(close, open) - low) / r, 6) AS lower_wick
FROM (SELECT *, greatest(high - low, 1e-10) AS r FROM bars)"""),
)
def _(t: Tables):
    return rounded(P.candle_shape(t.bars_h1()).select("symbol", "time", "close_position", "body_ratio", "upper_wick", "lower_wick"))


def _config(t: Tables):
    """Wide parameter rows per brand, derived from the parts of the brand."""
    return t.read("part").groupBy(F.col("p_brand").alias("symbol")).agg(
        (F.min("p_size") - 1).cast("double").alias("ema_fast"), (F.max("p_size") % 13).cast("double").alias("ema_slow"), (F.avg("p_size") - 14).alias("risk_percent"),
        (F.count(F.lit(1)) % 7).cast("double").alias("rr"), (F.count(F.lit(1)) % 20).cast("double").alias("cb_dd_pct"), F.lit(8.0).alias("tr_max_dd_pct"),
    )


_CONFIG = """SELECT p_brand AS symbol, CAST(min(p_size) - 1 AS DOUBLE) AS ema_fast, CAST(max(p_size) % 13 AS DOUBLE) AS ema_slow, avg(p_size) - 14 AS risk_percent,
  CAST(count(*) % 7 AS DOUBLE) AS rr, CAST(count(*) % 20 AS DOUBLE) AS cb_dd_pct, 8.0::DOUBLE AS tr_max_dd_pct FROM part GROUP BY 1"""


@query(
    "param_violations",
    sql(
        """SELECT symbol, 'risk_percent range' AS rule FROM cfg WHERE risk_percent <= 0 OR risk_percent > 10 UNION ALL SELECT symbol, 'rr range' FROM cfg WHERE rr <= 0 OR rr > 100
UNION ALL SELECT symbol, 'ema positive' FROM cfg WHERE ema_fast <= 0 OR ema_slow <= 0 UNION ALL SELECT symbol, 'ema_fast < ema_slow' FROM cfg WHERE ema_fast > 0 AND ema_slow > 0 AND ema_fast >= ema_slow
UNION ALL SELECT symbol, 'breaker > tail limit' FROM cfg WHERE cb_dd_pct <= tr_max_dd_pct""",
        cfg=_CONFIG,
    ),
)
def _(t: Tables):
    return P.param_violations(_config(t))


PARAM_KEYS = ["ema_fast", "ema_slow", "rr"]
_LONG = " UNION ALL ".join(f"SELECT symbol, '{k}' AS key, {k} AS value FROM cfg WHERE {k} > 2" for k in PARAM_KEYS)
_DEFAULTS = "SELECT * FROM (VALUES ('ema_fast', 10.0::DOUBLE), ('ema_slow', 40.0::DOUBLE), ('rr', 2.0::DOUBLE), ('sl', 1.5::DOUBLE)) t(key, value)"


def _resolved(t: Tables):
    own = _config(t).select("symbol", *PARAM_KEYS).unpivot("symbol", PARAM_KEYS, "key", "value").where(F.col("value") > 2)
    defaults = t.spark.createDataFrame([("ema_fast", 10.0), ("ema_slow", 40.0), ("rr", 2.0), ("sl", 1.5)], "key string, value double")
    return P.resolve_params(t.symbol_meta(), defaults, own)


_RESOLVED = {"cfg": _CONFIG, "own": _LONG, "dft": _DEFAULTS, "res": "SELECT s.symbol, d.key, coalesce(o.value, d.value) AS value, o.value IS NOT NULL AS overridden FROM symbol_meta s CROSS JOIN dft d LEFT JOIN own o ON o.symbol = s.symbol AND o.key = d.key"}


@query("resolve_params", sql("SELECT * FROM res", **_RESOLVED))
def _(t: Tables):
    return _resolved(t)


@query("label_params", sql("SELECT symbol, max(value) FILTER (key = 'sl') AS sl_atr, max(value) FILTER (key = 'sl') * max(value) FILTER (key = 'rr') AS tp_atr FROM res GROUP BY 1", **_RESOLVED))
def _(t: Tables):
    from tidemark.operators.labels import label_params

    return label_params(_resolved(t))


@query("parse_weights", sql("SELECT o_orderkey, 0.4::DOUBLE AS w_ml, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS w_spread, CASE WHEN o_custkey % 3 = 0 THEN 0.3::DOUBLE END AS w_news FROM orders"))
def _(t: Tables):
    o = t.read("orders")
    text = F.concat(F.lit("ml:0.4, spread:"), (F.col("o_orderkey") % 10 / 10).cast("string"), F.when(F.col("o_custkey") % 3 == 0, ",news:0.3").otherwise(",broken"))
    w = o.select("o_orderkey", P.parse_weights(text).alias("w"))
    return w.select("o_orderkey", *[F.try_element_at("w", F.lit(k)).alias(f"w_{k}") for k in ("ml", "spread", "news")])


ATR = Scan().atr_series("atr", 14).ctes("r")


@query("spread_filter", sql("SELECT b.symbol, b.rn, CASE WHEN spread > 0 AND atr > 0 THEN spread * 1.0 / atr <= 0.03 ELSE true END AS spread_ok FROM r JOIN bars b USING (symbol, rn)", **ATR))
def _(t: Tables):
    from tidemark.operators.indicators import atr_series_part, scan_parts

    return P.spread_filter(scan_parts(t.bars(), [atr_series_part("atr", 14)]), 1.0, 0.03).select("symbol", "rn", "spread_ok")


@query("capital_filter", sql("SELECT symbol, count(*) AS n FROM trades WHERE symbol NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) * 100 > 8000) GROUP BY 1"))
def _(t: Tables):
    limits = t.read("part").groupBy(F.col("p_brand").alias("symbol")).agg((F.count(F.lit(1)) * 100).alias("min_equity")).where(F.col("min_equity") > 7000)
    return P.capital_filter(t.trades(), limits, 8000.0).where("eligible").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("neutralize", sql("SELECT symbol, rn, round(coalesce(CASE WHEN tick_volume > 4 THEN close / open END, 0.5), 6) AS score FROM bars"))
def _(t: Tables):
    b = t.bars().withColumn("score", F.when(F.col("tick_volume") > 4, F.col("close") / F.col("open")).when(F.col("tick_volume") > 2, F.lit(float("nan"))).otherwise(F.lit(None)))
    return rounded(P.entity_neutral(b, ["score"], 0.5).select("symbol", "rn", "score"))


@query("parse_iso_time", sql("SELECT event_id, time - INTERVAL 5 HOURS AS east, time AS utc FROM (SELECT event_id, date_trunc('second', time) AS time FROM ticks)"))
def _(t: Tables):
    s = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
    return t.ticks().select("event_id", D.parse_iso(F.concat(s, F.lit("+05:00"))).alias("east"), D.parse_iso(F.concat(s, F.lit("Z"))).alias("utc"))


@query("trading_day", sql("SELECT event_id, CAST(time + INTERVAL 5 HOURS AS DATE) AS day, CAST(date_trunc('week', time + INTERVAL 5 HOURS) AS DATE) AS week FROM ticks"))
def _(t: Tables):
    day = D.trading_day("time")
    return t.ticks().select("event_id", day.alias("day"), D.week_start(day).alias("week"))


@query(
    "pnl_and_fills",
    sql("""SELECT symbol, rn, round(CASE WHEN close >= open THEN close - open ELSE open - close END / 0.01::DOUBLE * 0.5 * 2, 6) AS pnl,
round(CASE WHEN close >= open THEN open + (spread * 0.01::DOUBLE * 0.5 + 0.02::DOUBLE) ELSE open - (spread * 0.01::DOUBLE * 0.5 + 0.02::DOUBLE) END, 6) AS fill FROM bars"""),
)
def _(t: Tables):
    side = F.when(F.col("close") >= F.col("open"), F.lit("buy")).otherwise(F.lit("sell"))
    b = t.bars().withColumn("side", side)
    return rounded(b.select("symbol", "rn", M.pnl_currency(F.col("side"), F.col("open"), F.col("close"), 2, 0.01, 0.5).alias("pnl"), M.fill_price(F.col("side"), F.col("open"), F.col("spread"), 0.01, 2.0).alias("fill")))


@query("guarded_math", sql("SELECT symbol, rn, round(close / greatest(tick_volume - 3, 1), 6) AS q, round(least(greatest(close / 50, 0.5), 2), 6) AS c, round(round_even(close / 0.25, 0) * 0.25, 6) AS s FROM bars"))
def _(t: Tables):
    return rounded(t.bars().select("symbol", "rn", M.safe_div("close", F.col("tick_volume") - 3, 1.0).alias("q"), M.clip(F.col("close") / 50, 0.5, 2.0).alias("c"), M.round_step("close", 0.25).alias("s")))


@query("target_fallback", sql("SELECT ticket, line, [0.5::DOUBLE, 0.75::DOUBLE][least(line, 2)] AS target FROM trades"))
def _(t: Tables):
    return t.trades().select("ticket", "line", M.target_at(F.array(F.lit(0.5), F.lit(0.75)), F.col("line") - 1).alias("target"))


@query("norm_quantiles", sql("SELECT symbol, rn, round(p, 6) AS p_back FROM (SELECT symbol, rn, rn / (count(*) OVER (PARTITION BY symbol) + 1) AS p FROM bars)"))
def _(t: Tables):
    """The distribution function of the quantile gives the probability back."""
    b = t.bars()
    n = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("rn") / (F.col("n") + 1)
    return rounded(b.join(n, "symbol").select("symbol", "rn", M.norm_cdf(M.norm_ppf(p)).alias("p_back")))
