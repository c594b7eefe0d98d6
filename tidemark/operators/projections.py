"""Row-level projections, filters and rule checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, as_col


def closed_bars(bars: DataFrame) -> DataFrame:
    """Drop the newest (still forming) bar of every symbol; a symbol with one bar keeps it."""
    edge = bars.groupBy("symbol").agg(F.max("time").alias("__last"), F.count(F.lit(1)).alias("__n"))
    joined = bars.join(edge, "symbol")
    return joined.where((F.col("time") < F.col("__last")) | (F.col("__n") == 1)).drop("__last", "__n")


# Asset class of the traded instruments.
ASSET_CLASS = {
    "ETHUSD.raw": "crypto", "BTCUSD.raw": "crypto", "LTCUSD.raw": "crypto", "DOGUSD.raw": "crypto", "ADAUSD.raw": "crypto",
    "BNBUSD.raw": "crypto", "SOLUSD.raw": "crypto", "XRPUSD.raw": "crypto",
    "EURUSD.raw": "forex", "GBPUSD.raw": "forex", "USDJPY.raw": "forex", "EURJPY.raw": "forex", "GBPJPY.raw": "forex",
    "NZDUSD.raw": "forex", "AUDUSD.raw": "forex", "USDCAD.raw": "forex", "USDCHF.raw": "forex",
    "XAUUSD.raw": "commodity", "XAGUSD.raw": "commodity", "XNGUSD.raw": "commodity", "XAU500.raw": "commodity", "XPTUSD.raw": "commodity",
    "US30.raw": "index", "SPY.raw": "index", "US500.raw": "index", "IWM.raw": "index",
}

# Substrings that place a symbol in a category, tried in this order.
CURRENCY_CODES = "USD JPY GBP CHF AUD NZD CAD NOK SEK DKK PLN SGD HKD ZAR MXN TRY".split()
INDEX_CODES = "US500 US30 UK100 DE40 AUS200 CN50 FR40 JP225 ES35 STOXX NAS100 SPX".split()
COIN_CODES = (
    "BTC ETH DOG LTC XRP ADA SOL DOT BNB AVAX MATIC ATOM LINK UNI FIL ICP NEAR APT ARB OP SUI SEI TIA INJ RUNE AAVE CRV MKR COMP YFI "
    "SNX SUSHI CAKE AXS SAND MANA ENJ GALA CHZ BCH EOS TRX XLM ALGO FTM AVX AVGO"
).split()
COMMODITY_CODES = "XAU XAG XPT XPD UKO USO XNG XAUEUR".split()
CATEGORY_RULES = (("FOREX", CURRENCY_CODES), ("INDICES", INDEX_CODES), ("CRYPTO", COIN_CODES), ("COMMOD", COMMODITY_CODES))


def with_asset_class(df: DataFrame, classes: Mapping[str, str] | None = None) -> DataFrame:
    """Asset class by symbol; null where unknown. The table has one entry per instrument, so it is a map literal."""
    table = ASSET_CLASS if classes is None else classes
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn("asset_class", F.try_element_at(lookup, F.col("symbol")))


def classify_symbol(symbol: Column | str, rules=CATEGORY_RULES, default: str = "STOCKS") -> Column:
    """First category one of whose codes occurs in the upper-cased symbol."""
    s = F.upper(as_col(symbol))
    out = None
    for category, codes in rules:
        hit = s.rlike("|".join(codes))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default)


def session_flags(df: DataFrame) -> DataFrame:
    h = F.hour("time")
    one = lambda c: c.cast("double")
    return df.withColumns({
        "is_london": one((h >= 8) & (h < 17)), "is_ny": one((h >= 13) & (h < 22)), "is_overlap": one((h >= 13) & (h < 17)), "is_asian": one(h < 9),
    })


def session_gate(
    df: DataFrame, only_session=False, require_overlap=False, skip_asian=False, open_=13, close=22, asian_open=5, asian_close=12
) -> DataFrame:
    """Hour gate; the first enabled rule decides, all bounds inclusive."""
    h = F.hour("time")
    if only_session:
        ok = h.between(open_, close)
    elif require_overlap:
        ok = h.between(12, 17)
    elif skip_asian:
        ok = ~h.between(asian_open, asian_close)
    else:
        ok = F.lit(True)
    return df.withColumn("session_ok", ok)


def time_features(df: DataFrame) -> DataFrame:
    """Hour of day and day of week (Monday 0) on the unit circle."""
    hour, day = 2 * F.pi() * F.hour("time") / 24, 2 * F.pi() * F.weekday("time") / 7
    return df.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)})


def candle_shape(df: DataFrame) -> DataFrame:
    rng = F.greatest(F.col("high") - F.col("low"), F.lit(TINY))
    o, c = F.col("open"), F.col("close")
    return df.withColumns({
        "close_position": (c - F.col("low")) / rng, "body_ratio": F.abs(c - o) / rng,
        "upper_wick": (F.col("high") - F.greatest(c, o)) / rng, "lower_wick": (F.least(c, o) - F.col("low")) / rng,
    })


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "ret_5_x_vol_20": F.col("ret_5") * F.col("volatility_20"), "vol_ratio_x_ret_1": F.col("vol_ratio") * F.col("ret_1"),
        "ret_1_x_adx": F.col("ret_1") * F.col("adx_14"),
    })


def prepare_features(df: DataFrame, features: Sequence[str], missing: int = 5) -> DataFrame:
    """Infinities to null, missing order flow to 0, keep rows with at most `missing` unknown features."""
    cols = {}
    for c in features:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        cols[c] = F.coalesce(v, F.lit(0.0)) if c.startswith("of_") else v
    return df.withColumns(cols).dropna(thresh=len(features) - missing, subset=list(features))


def resolve_params(symbols: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(symbol, key, value): the symbol's override, else the global default. Both tables are configuration."""
    grid = symbols.select("symbol").distinct().crossJoin(F.broadcast(defaults.select("key", F.col("value").alias("__default"))))
    own = overrides.select("symbol", "key", F.col("value").alias("__own"))
    return grid.join(own, ["symbol", "key"], "left").select(
        "symbol", "key", F.coalesce("__own", "__default").alias("value"), F.col("__own").isNotNull().alias("overridden")
    )


# Fixed values: (parameter, lower bound, lower bound allowed, upper bound).
PARAM_RANGES = (
    ("risk_percent", 0, False, 10), ("daily_loss_pct", 0, False, 100), ("max_positions", 0, False, 1000), ("atr_period", 0, False, 10000),
    ("atr_sl_mult", 0, False, 100), ("rr", 0, False, 100), ("dr_kelly_fraction", 0, False, 1), ("scoring_min_entry", 0, True, 1),
    ("ml_confidence", 0, True, 1),
)


def param_violations(params: DataFrame, key: str = "symbol", ranges=PARAM_RANGES) -> DataFrame:
    """One row per violated rule of each wide parameter row; columns a table does not have are not checked."""
    have = set(params.columns)
    checks = []

    def rule(name: str, broken: Column):
        checks.append(F.struct(F.lit(name).alias("rule"), F.coalesce(broken, F.lit(False)).alias("broken")))

    for name, lo, closed, hi in ranges:
        if name in have:
            c = F.col(name)
            rule(f"{name} range", (c < lo if closed else c <= lo) | (c > hi))
    if {"ema_fast", "ema_slow"} <= have:
        bad_sign = (F.col("ema_fast") <= 0) | (F.col("ema_slow") <= 0)
        rule("ema positive", bad_sign)
        rule("ema_fast < ema_slow", ~bad_sign & (F.col("ema_fast") >= F.col("ema_slow")))
    if {"cb_dd_pct", "tr_max_dd_pct"} <= have:
        rule("breaker > tail limit", F.col("cb_dd_pct") <= F.col("tr_max_dd_pct"))
    if {"adx_range_threshold", "adx_trend_threshold"} <= have:
        ar = F.col("adx_range_threshold")
        rule("0 < adx range < trend", ~((ar > 0) & (ar < F.col("adx_trend_threshold"))))
    broken = F.filter(F.array(*checks), lambda c: c["broken"])
    return params.select(key, F.explode(broken).alias("c")).select(key, F.col("c.rule").alias("rule"))


def parse_weights(col: Column | str) -> Column:
    """``"a:0.4,b:0.6"`` as a map of doubles; entries without a colon are dropped."""
    parts = F.filter(F.split(as_col(col), ","), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))), F.split_part(p, F.lit(":"), F.lit(2)).cast("double")))
    return F.map_from_entries(pairs)


def spread_filter(df: DataFrame, point: float = 0.01, max_ratio: float = 0.30) -> DataFrame:
    """spread * point / atr <= max_ratio; passes where either is missing or not positive."""
    known = (F.col("spread") > 0) & (F.col("atr") > 0)
    return df.withColumn("spread_ok", F.coalesce(F.when(known, F.col("spread") * point / F.col("atr") <= max_ratio), F.lit(True)))


def capital_filter(df: DataFrame, limits: DataFrame, equity: float) -> DataFrame:
    """Symbols whose minimum equity is met; unset or non-positive minima pass."""
    ok = F.coalesce((F.col("min_equity") <= 0) | (F.lit(equity) >= F.col("min_equity")), F.lit(True))
    return df.join(limits, "symbol", "left").withColumn("eligible", ok)


def entity_neutral(df: DataFrame, cols: Sequence[str], value: float) -> DataFrame:
    from tidemark.functions.numbers import neutral

    return df.withColumns({c: neutral(c, value) for c in cols})
