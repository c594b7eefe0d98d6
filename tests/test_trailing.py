"""Trailing exits and extremes against plain loops, with rounds and blocks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from tests.conftest import SMALL
from tidemark.operators import trailing as TR
from tidemark.session import settle


@pytest.fixture(scope="module")
def market(spark, hot):
    pdf, _ = hot
    rng = np.random.default_rng(3)
    bars = pdf[["symbol", "rn", "time", "high", "low", "close"]].assign(atr=0.4 + rng.random(len(pdf)), accel=rng.choice([0.8, 1.0, 1.3], len(pdf)))
    rows = []
    for symbol, n in (("HOT", 45), ("COLD", 6), ("NONE", 1)):
        own = bars[bars["symbol"] == symbol]
        for i in range(n):
            at = own.iloc[rng.integers(0, len(own))] if len(own) else bars.iloc[0]
            side = rng.choice(["buy", "sell"])
            price = float(at["close"])
            risk = float(rng.choice([0.5, 2.0, 50.0]))
            when = [pd.Timestamp("2023-12-01"), at["time"], at["time"] + pd.Timedelta(minutes=30), pd.Timestamp("2030-01-01")][rng.choice(4, p=[0.1, 0.4, 0.4, 0.1])]
            rows.append((i, symbol, side, price, price - risk if side == "buy" else price + risk, when))
    positions = pd.DataFrame(rows, columns=["no", "symbol", "type", "price_open", "sl", "time"])
    to = lambda d: d.withColumn("time", F.col("time").cast("timestamp_ntz"))
    return bars, positions, settle(to(spark.createDataFrame(bars))), settle(to(spark.createDataFrame(positions)))


def _walk(p, bars):
    own = bars[bars["symbol"] == p.symbol].sort_values("rn")
    if not len(own):
        return None
    before = own[own["time"] < p.time]
    start = before["rn"].max() if len(before) else own["rn"].min()
    sign = 1 if p.type == "buy" else -1
    level = p.price_open + sign * abs(p.price_open - p.sl) * 2 * 0.5
    peak, line, partial = -np.inf, p.sl * sign, None
    for b in own[own["rn"] >= start].itertuples():
        high, low = (b.high, b.low) if sign == 1 else (-b.low, -b.high)
        after = b.time > p.time
        peak = max(peak, high)
        if after and partial is None and high >= level * sign:
            partial = b.time
        risk = max(abs(p.price_open - p.sl), 1e-10)
        mult = (1.5 if partial is not None else 1.5 if (b.close - p.price_open) * sign / risk >= 3 else 3.5) * b.accel
        line = max(line, peak - b.atr * mult)
        if after and low <= line:
            return b.rn, b.time, line * sign, partial if partial is not None and partial < b.time else None, peak * sign
    return None, None, None, partial, peak * sign


@pytest.mark.parametrize(("block", "span"), [(4, 4), (4, 64), (256, 16_384)])
def test_exits_equal_a_walk_over_all_bars(market, block, span):
    bars, positions, b, p = market
    started = TR.with_start(p, b)
    out = TR.trail(started, b, TR.stop_mult(F.col("close"), F.col("partial"), F.col("accel")), ["symbol", "no"], TR.partial_level(0.5), block, span)
    got = {(r["symbol"], r["no"]): r for r in out.collect()}
    seen = 0
    for row in positions.itertuples():
        want = _walk(row, bars)
        if want is None:
            assert (row.symbol, row.no) not in got
            continue
        r = got.pop((row.symbol, row.no))
        rn, when, stop, partial, peak = want
        assert r["exit_rn"] == rn and (r["exit_time"] is None) == (when is None)
        assert r["exit_time"] is None or pd.Timestamp(r["exit_time"]) == when
        assert r["exit_stop"] is None or np.isclose(r["exit_stop"], stop)
        assert (None if r["partial_time"] is None else pd.Timestamp(r["partial_time"])) == partial
        assert np.isclose(r["extreme"], peak)
        seen += rn is not None
    assert not got and seen > 5


@pytest.mark.parametrize("block", [1, 5, 64, 4096])
def test_extremes_of_intervals(spark, market, block):
    bars, _, b, _ = market
    rng = np.random.default_rng(block)
    asked = []
    for i in range(120):
        symbol, n = ("HOT", 700) if i % 4 else ("COLD", 40)
        a, z = sorted(rng.integers(1, n + 1, 2).tolist())
        asked.append((i % 100, symbol, a, z))
    asked += [(900, "HOT", 20, 10), (901, "NONE", 1, 2), asked[0]]
    out = TR.extreme_between(spark.createDataFrame(asked, "no long, symbol string, from_rn long, to_rn long"), b, block).collect()
    assert len(out) == len(asked)
    for r in out:
        own = bars[(bars["symbol"] == r["symbol"]) & (bars["rn"] >= r["from_rn"]) & (bars["rn"] <= r["to_rn"])]
        if len(own):
            assert (r["highest"], r["lowest"]) == (own["high"].max(), own["low"].min())
        else:
            assert r["highest"] is None and r["lowest"] is None


def test_no_positions(market):
    _, _, b, p = market
    out = TR.trail(TR.with_start(p.where("false"), b), b, F.lit(2.0), ["symbol", "no"])
    assert out.count() == 0 and "exit_stop" in out.columns


def test_acceleration_rules(spark):
    df = spark.createDataFrame([("buy", 1.5), ("sell", 1.5), ("buy", 0.7), ("sell", 0.995), ("buy", None)], "type string, r double")
    rows = df.select(TR.acceleration(F.col("r")), TR.acceleration_live(F.col("r"))).collect()
    assert np.allclose([r[0] for r in rows], [0.9, 0.9, 1.06, 1.001, 1.0])
    assert np.allclose([r[1] for r in rows], [0.8, 1.2, 1.2, 1.0, 1.0])


@pytest.mark.parametrize("name", ["chandelier_exit", "extreme_since_entry", "exit_sweep"])
def test_queries_equal_sql(tables, name):
    from tests.compare import connect
    from tidemark.plans import catalog

    ok, why, n = compare(catalog.QUERIES[name](tables), connect(SMALL), catalog.SQL[name])
    assert ok and n, why
