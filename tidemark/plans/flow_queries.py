"""Resampling and order flow."""

from pyspark.sql import functions as F

from tidemark.operators import resample as R
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, sql


def rounded(df, digits=6, **names):
    """Round every double column, so that summation order cannot show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("bars_hourly", sql("SELECT symbol, time, open, high, low, close, tick_volume, round(spread, 6) AS spread, rn FROM bars"))
def _(t: Tables):
    return rounded(t.bars())


@query("bars_minute", sql("SELECT symbol, time, open, high, low, close, tick_volume FROM bars_m1"))
def _(t: Tables):
    return t.bars_m1().drop("spread")


@query("resample_h4", sql("SELECT symbol, time, open, high, low, close, CAST(tick_volume AS BIGINT) AS tick_volume, available_at, rn FROM bars_h4"))
def _(t: Tables):
    return t.htf("4 hours")


@query("resample_d1", sql("SELECT symbol, time, open, high, low, close, CAST(tick_volume AS BIGINT) AS tick_volume, available_at, rn FROM bars_d1"))
def _(t: Tables):
    return t.htf("1 day")


@query(
    "tick_orderflow",
    sql(
        """SELECT symbol, time, CAST(bv - sv AS DOUBLE) AS of_cum_delta, round((bv - sv) / greatest(bv + sv, 1), 6) AS of_delta_ratio,
  round((nu - nd) / n, 6) AS of_tick_imb, round(sp, 6) AS of_avg_spread, round(bv / greatest(bv + sv, 1), 6) AS of_buy_ratio, n AS n_ticks
FROM (SELECT symbol, hour AS time, CAST(sum(CASE WHEN d > 0 THEN volume ELSE 0 END) AS DOUBLE) AS bv,
  CAST(sum(CASE WHEN d < 0 THEN volume ELSE 0 END) AS DOUBLE) AS sv,
  CAST(count(*) FILTER (d > 0) AS DOUBLE) AS nu, CAST(count(*) FILTER (d < 0) AS DOUBLE) AS nd, count(*) AS n, avg(ask - bid) AS sp
  FROM dirs GROUP BY symbol, hour) WHERE n >= 5""",
        dirs="""SELECT *, date_trunc('hour', time) AS hour,
  last - lag(last) OVER (PARTITION BY symbol, date_trunc('hour', time) ORDER BY time, event_id) AS d FROM ticks""",
    ),
)
def _(t: Tables):
    return rounded(R.tick_orderflow(t.ticks()))


@query(
    "m1_orderflow",
    sql(
        """SELECT b.symbol, b.time, b.close, CAST(bv - sv AS DOUBLE) AS of_cum_delta, round((bv - sv) / (bv + sv), 6) AS of_delta_ratio,
  round((nu - nd) / n, 6) AS of_tick_imb, round(sp, 6) AS of_avg_spread, round(bv / (bv + sv), 6) AS of_buy_ratio
FROM bars b LEFT JOIN (SELECT * FROM flow WHERE bv + sv > 0) f ON f.symbol = b.symbol AND f.hour = b.time""",
        flow="""SELECT symbol, date_trunc('hour', time) AS hour, CAST(sum(CASE WHEN close > open THEN tick_volume ELSE 0 END) AS DOUBLE) AS bv,
  CAST(sum(CASE WHEN close < open THEN tick_volume ELSE 0 END) AS DOUBLE) AS sv, CAST(count(*) FILTER (close > open) AS DOUBLE) AS nu,
  CAST(count(*) FILTER (close < open) AS DOUBLE) AS nd, avg(spread) AS sp, count(*) AS n FROM bars_m1 GROUP BY 1, 2""",
    ),
)
def _(t: Tables):
    return rounded(R.m1_orderflow(t.bars_h1().select("symbol", "time", "close"), t.bars_m1()))


TAPE_SQL = """SELECT symbol, time, n_m1, round(pressure, 6) AS pressure, round(ra, 6) AS range_active,
  (ok AND pressure < 0.35 AND ra > 1.0) AS block_buy, (ok AND pressure > 0.65 AND ra > 1.0) AS block_sell
FROM (SELECT symbol, hour AS time, count(*) AS n_m1, avg(close_pos) FILTER (k <= 5) AS pressure,
  avg(rng) FILTER (k <= 5) / (avg(rng) + 1e-10) AS ra, count(*) >= 2 AND avg(rng) > 0 AS ok
  FROM (SELECT symbol, date_trunc('hour', time) AS hour, high - low AS rng, (close - low) / (high - low + 1e-10) AS close_pos,
    row_number() OVER (PARTITION BY symbol, date_trunc('hour', time) ORDER BY time DESC) AS k FROM bars_m1) WHERE k <= 20 GROUP BY symbol, hour)"""


@query("tape_pressure", sql(TAPE_SQL))
def _(t: Tables):
    # The minute bars of the sample are sparse, so the gate needs two of them here instead of ten.
    return rounded(R.tape_pressure(t.bars_m1(), min_bars=2, active=1.0))


@query("closed_bars", sql("SELECT symbol, time, close FROM (SELECT *, max(time) OVER (PARTITION BY symbol) AS mt, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE time < mt OR n = 1"))
def _(t: Tables):
    from tidemark.operators.projections import closed_bars

    return closed_bars(t.bars_h1()).select("symbol", "time", "close")
