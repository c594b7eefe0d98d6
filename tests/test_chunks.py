"""The chunked operators against pandas, with chunks far smaller than the keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import month_of
from tidemark.operators import equity
from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import montecarlo as MC
from tidemark.operators import signals as S
from tidemark.operators import trades as X
from tidemark.operators import windows as N
from tidemark.operators.chunks import affine_scan, chunk_of, compose_prefix, index_rows, rolling, running
from tidemark.operators.joins import asof_join
from tidemark.operators.orderstats import quantiles, rank_table
from tidemark.session import settle

ROWS = 13


def frame(df, *cols):
    return df.select("symbol", "rn", *cols).toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True)


def test_index_rows_two_levels(spark, hot):
    pdf, df = hot
    shuffled = df.drop("rn").orderBy(F.rand(3))
    got = index_rows(shuffled, ["symbol"], [F.to_date("time"), F.hour("time")], ["time"]).select("symbol", "time", "rn").toPandas()
    want = pdf.sort_values("time").assign(want=lambda d: d.groupby("symbol").cumcount() + 1)[["symbol", "time", "want"]]
    both = got.merge(want, on=["symbol", "time"])
    assert len(both) == len(pdf) and (both["rn"] == both["want"]).all()


def test_index_rows_without_key(spark, hot):
    pdf, df = hot
    got = index_rows(df, [], [month_of("time"), F.dayofmonth("time")], ["time", "symbol"], "k").toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(1, len(pdf) + 1))
    assert got["time"].is_monotonic_increasing


@pytest.mark.parametrize("rows", [1, ROWS, 10_000])
def test_rolling_and_running(hot, rows):
    pdf, df = hot
    out = rolling(df, lambda d, w: d.withColumn("m", F.avg("close").over(w.rowsBetween(-4, 0))).withColumn("nx", F.lead("close", 3).over(w)), back=4, ahead=3, rows=rows)
    out = running(out, {"s": ("sum", F.col("tick_volume")), "hi": ("max", F.col("close")), "lo": ("min", F.col("close")), "f": ("last", F.when(F.col("tick_volume") > 45, F.col("rn")))}, rows=rows)
    got = frame(out, "m", "nx", "s", "hi", "lo", "f")
    g = pdf.sort_values(["symbol", "rn"]).groupby("symbol")
    assert np.allclose(got["m"], g["close"].transform(lambda c: c.rolling(5, min_periods=1).mean()))
    assert np.allclose(got["nx"], g["close"].shift(-3), equal_nan=True)
    assert (got["s"].values == g["tick_volume"].cumsum().values).all()
    assert np.allclose(got["hi"], g["close"].cummax()) and np.allclose(got["lo"], g["close"].cummin())
    marked = pdf.sort_values(["symbol", "rn"]).assign(m=lambda d: d["rn"].where(d["tick_volume"] > 45)).groupby("symbol")["m"].ffill()
    assert np.allclose(got["f"].astype(float), marked.values, equal_nan=True)


def test_compose_prefix_restarts_after_nan():
    a = np.array([[0.0], [0.5], [0.0], [0.5]])
    b = np.array([[np.nan], [1.0], [4.0], [1.0]])
    _, y = compose_prefix(a, b)
    assert np.isnan(y[:2]).all() and y[2, 0] == 4.0 and y[3, 0] == 3.0


@pytest.mark.parametrize("rows", [1, ROWS, 10_000])
def test_ema_equals_pandas(hot, rows):
    pdf, df = hot
    got = frame(I.scan_parts(df, [I.ema_part("y", 9)], rows=rows), "y")
    want = pdf.sort_values(["symbol", "rn"]).groupby("symbol")["close"].transform(lambda c: c.ewm(span=9, adjust=False).mean())
    assert np.allclose(got["y"], want, rtol=0, atol=1e-10)


def kama_loop(x, n):
    y = np.full(len(x), np.nan)
    if len(x) >= n:
        y[n - 1] = x[n - 1]
    for i in range(n, len(x)):
        path = np.abs(np.diff(x[i - n : i + 1])).sum()
        er = abs(x[i] - x[i - n]) / path if path > 0 else 0.0
        sc = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        y[i] = y[i - 1] + sc * (x[i] - y[i - 1])
    return y


def test_kama_equals_loop(hot):
    pdf, df = hot
    got = frame(I.scan_parts(df, [I.kama_part("y", 10)], rows=ROWS), "y")
    want = np.concatenate([kama_loop(g["close"].values, 10) for _, g in pdf.sort_values(["symbol", "rn"]).groupby("symbol")])
    assert np.allclose(got["y"].astype(float), want, atol=1e-9, equal_nan=True)


OPERATORS = {
    "adx": lambda d, r: (I.adx(d, 14, rows=r), ["adx"]),
    "adx_ewm": lambda d, r: (I.adx_ewm(d, 14, rows=r), ["adx", "adx_plus"]),
    "macd": lambda d, r: (I.macd_kama(d, rows=r), ["macd", "macd_signal"]),
    "rsi_bounded": lambda d, r: (I.rsi_bounded(d, rows=r), ["rsi_bounded"]),
    "moments": lambda d, r: (N.rolling_moments(d, rows=r), ["skew_20", "kurt_20"]),
    "autocorr": lambda d, r: (N.rolling_autocorr(d, rows=r), ["autocorr_5"]),
    "obv": lambda d, r: (N.obv(d, rows=r), ["obv", "obv_slope_5"]),
    "vwap": lambda d, r: (N.vwap(d, rows=r), ["vwap"]),
    "frac": lambda d, r: (N.frac_diff(d, 0.3, rows=r), ["fd_close"]),
    "divergence": lambda d, r: (N.volume_filter(d, rows=r), ["pass_buy", "pass_sell"]),
    "drawdown": lambda d, r: (N.drawdown(d, "close", rows=r), ["dd_pct"]),
    "labels": lambda d, r: (L.r_multiple(d.withColumn("atr_14", F.lit(1.0)), rows=r), ["r_multiple"]),
    "hysteresis": lambda d, r: (S.hysteresis(d, "close", 100.0, 2.0, rows=r), ["gate_open"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunk_size_does_not_matter(hot, name):
    _, df = hot
    small, cols = OPERATORS[name](df, ROWS)
    big, _ = OPERATORS[name](df, 100_000)
    a, b = frame(small, *cols), frame(big, *cols)
    for c in cols:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-8, equal_nan=True), c


def test_asof_join_equals_merge_asof(hot, spark):
    pdf, df = hot
    right = pdf[pdf["tick_volume"] > 30][["symbol", "time", "close"]].rename(columns={"close": "x"})
    r = spark.createDataFrame(right).withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = asof_join(df.select("symbol", "time"), r, ["x"], rows=ROWS).toPandas().sort_values(["symbol", "time"])
    want = pd.merge_asof(pdf[["symbol", "time"]].sort_values("time"), right.sort_values("time"), on="time", by="symbol").sort_values(["symbol", "time"])
    assert np.allclose(got["x"].astype(float), want["x"], equal_nan=True)


def test_equity_and_streaks(hot):
    pdf, df = hot
    d = df.withColumn("pnl", F.round(F.col("close") - 100, 4).cast("decimal(18,4)"))
    got = frame(X.equity_curve(d, 1000.0, rows=ROWS).withColumn("dd", F.col("drawdown").cast("double")), "dd")
    p = pdf.sort_values(["symbol", "rn"]).copy()
    p["eq"] = 1000 + (p["close"] - 100).groupby(p["symbol"]).cumsum()
    peak = p.groupby("symbol")["eq"].cummax().clip(lower=1000)
    assert np.allclose(got["dd"], peak - p["eq"], atol=1e-6)
    runs = X.streaks(d, rows=ROWS).groupBy("symbol").agg(F.max("length").alias("m")).toPandas().set_index("symbol")["m"]
    for s, g in p.groupby("symbol"):
        w = (g["close"] - 100).round(4) > 0
        assert runs[s] == w.groupby((w != w.shift()).cumsum()).size().max()


def test_quantiles_and_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(500, 3.0), rng.normal(0, 5, 901)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    row = quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.percentile(values, [10, 50, 93]))
    t = rank_table(df, ["k"], "v").toPandas().set_index("v")
    assert t["n"].max() == 500 and t.loc[3.0, "below"] == (values < 3.0).sum() and (t["total"] == len(values)).all()


def test_reshuffle_is_complete_and_repeatable(hot):
    pdf, df = hot
    d = settle(df.withColumn("pnl", F.round(F.col("close") - 100, 4).cast("decimal(18,4)")))
    a = MC.reshuffle(d, 3, rows=ROWS).toPandas().sort_values(["symbol", "sim"]).reset_index(drop=True)
    b = MC.reshuffle(d, 3).toPandas().sort_values(["symbol", "sim"]).reset_index(drop=True)
    assert np.allclose(a["max_dd"], b["max_dd"]) and np.allclose(a["sharpe"], b["sharpe"])
    total = (pdf["close"] - 100).groupby(pdf["symbol"]).sum()
    assert all(abs(r["final_pnl"] - total[r["symbol"]]) < 1e-6 for _, r in a.iterrows())


def non_overlap_loop(bars, signals):
    """One position at a time, bar by bar."""
    out, pos = [], None
    at = {s["rn"]: s for s in signals}
    for b in bars:
        s = at.get(b["rn"])
        if pos:
            long = pos["signal"] == "buy"
            sl = b["low"] <= pos["sl"] if long else b["high"] >= pos["sl"]
            tp = b["high"] >= pos["tp"] if long else b["low"] <= pos["tp"]
            if sl or tp:
                out.append((pos["rn"], b["rn"], "SL" if sl else "TP"))
                pos = None
                continue
            if s and s["signal"] != pos["signal"]:
                out.append((pos["rn"], b["rn"], "REVERSE"))
                pos = None
        if s and pos is None:
            pos = s
    if pos:
        out.append((pos["rn"], bars[-1]["rn"], "END"))
    return out


@pytest.mark.parametrize("chunk", [None, 7])
def test_non_overlapping_trades_equal_the_loop(hot, spark, chunk):
    pdf, df = hot
    rng = np.random.default_rng(5)
    rows = []
    for s, g in pdf.groupby("symbol"):
        pick = np.sort(rng.choice(g["rn"].values, len(g) // 4, replace=False))
        for rn in pick:
            c, side = g.loc[g["rn"] == rn, "close"].iloc[0], "buy" if rng.random() < 0.5 else "sell"
            sign = 1 if side == "buy" else -1
            rows.append({"symbol": s, "param_id": 1, "rn": int(rn), "signal": side, "close": float(c), "sl": float(c - sign * 1.5), "tp": float(c + sign * 2.5)})
    sig = spark.createDataFrame(pd.DataFrame(rows))
    got = L.non_overlapping_trades(sig, df, rows=chunk).toPandas()
    for s, g in pdf.groupby("symbol"):
        want = non_overlap_loop(g.sort_values("rn").to_dict("records"), [r for r in rows if r["symbol"] == s])
        mine = sorted(zip(got[got.symbol == s]["entry_rn"], got[got.symbol == s]["exit_rn"], got[got.symbol == s]["exit_reason"]))
        assert mine == sorted(want)


@pytest.mark.parametrize("spans", [(35, 7), (4,)])
def test_first_touch_over_many_spans(hot, spark, spans):
    pdf, df = hot
    rng = np.random.default_rng(9)
    rows = []
    for s, g in pdf.groupby("symbol"):
        for i, r in enumerate(g.sort_values("rn").to_dict("records")):
            sign, far = (1 if rng.random() < 0.5 else -1), float(rng.choice([0.5, 2.0, 6.0, 50.0]))
            until = r["rn"] + int(rng.integers(-1, 90)) if i % 3 else len(g)
            rows.append((s, r["rn"], "buy" if sign > 0 else "sell", r["close"] - sign * far, r["close"] + sign * far, min(until, len(g))))
    sig = spark.createDataFrame(rows, "symbol string, rn long, signal string, sl double, tp double, until_rn long")
    got = {(r.symbol, r.rn): (r.touch_rn, r.touch) for r in L.first_touch(sig, df, [], spans).collect()}
    for s, g in pdf.groupby("symbol"):
        hi, lo = (dict(zip(g["rn"], g[c])) for c in ("high", "low"))
        for _, rn, side, sl, tp, until in (r for r in rows if r[0] == s):
            want = (None, None)
            for k in range(rn + 1, until + 1):
                stop, target = (lo[k] <= sl, hi[k] >= tp) if side == "buy" else (hi[k] >= sl, lo[k] <= tp)
                if stop or target:
                    want = (k, "SL" if stop else "TP")
                    break
            assert got[s, rn] == want


def test_signal_outcome_equals_the_loop(hot):
    pdf, df = hot
    sig = df.where(F.col("rn") % 9 == 0).withColumn("signal", F.when(F.col("tick_volume") > 25, "buy").otherwise("sell")).withColumn("atr", F.lit(1.2))
    got = L.signal_outcome(sig, df, 1.0, 2.0, horizon=60).select("symbol", "rn", "signal", "close", "r").collect()
    for row in got:
        b = pdf[(pdf.symbol == row["symbol"]) & (pdf.rn > row["rn"]) & (pdf.rn < row["rn"] + 60)].sort_values("rn")
        sign = 1 if row["signal"] == "buy" else -1
        sl, tp, want = row["close"] - sign * 1.2, row["close"] + sign * 2.4, 0.0
        for hi, lo in zip(b["high"], b["low"]):
            if (lo <= sl + 1e-9) if sign > 0 else (hi >= sl - 1e-9):
                want = -1.0
                break
            if (hi >= tp - 1e-9) if sign > 0 else (lo <= tp + 1e-9):
                want = 2.0
                break
        assert row["r"] == want


# --- equity in one pass ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def results(spark, hot):
    """Results per symbol with gains, losses and zeros; HOT has 700 rows, far more than a chunk of the tests."""
    pdf, _ = hot
    rng = np.random.default_rng(5)
    pnl = np.round(rng.normal(-0.05, 3, len(pdf)), 2)
    pnl[rng.random(len(pdf)) < 0.1] = 0
    pdf = pdf.assign(pnl=pnl)
    return pdf, settle(spark.createDataFrame(pdf[["symbol", "rn", "time", "pnl"]]).withColumn("pnl", F.col("pnl").cast("decimal(18,4)")).withColumn("time", F.col("time").cast("timestamp_ntz")))


def _walk(values, from_start):
    total, peak, fall, high, low = 0.0, 0.0 if from_start else -np.inf, 0.0, -np.inf, np.inf
    for v in values:
        total += v
        peak, high, low = max(peak, total), max(high, total), min(low, total)
        fall = max(fall, peak - total)
    return total, high, low, fall


@pytest.mark.parametrize("rows", [1, 7, ROWS, 10_000])
@pytest.mark.parametrize("from_start", [True, False])
def test_pieces_of_a_path_fold_to_the_walk(results, rows, from_start):
    pdf, df = results
    got = equity.folded(df, F.col("pnl"), ["symbol"], chunk_of(rows), ["rn"], {"n": ("sum", F.lit(1)), "best": ("max", F.col("pnl"))}, from_start)
    for r in got.collect():
        own = pdf[pdf["symbol"] == r["symbol"]].sort_values("rn")["pnl"]
        assert np.allclose([float(r[c]) for c in ("total", "high", "low", "fall")], _walk(own, from_start))
        assert r["n"] == len(own) and float(r["best"]) == own.max()


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_paths_and_day_losses_do_not_depend_on_chunks(results, rows):
    pdf, df = results
    got = frame(equity.path(df, F.col("pnl"), rows=rows), "cum", "top").astype({"cum": float, "top": float})
    g = pdf.sort_values(["symbol", "rn"]).groupby("symbol")["pnl"]
    assert np.allclose(got["cum"], g.cumsum()) and np.allclose(got["top"], g.cumsum().groupby(pdf.sort_values(["symbol", "rn"])["symbol"]).cummax())
    day = frame(N.day_loss(df, 100.0, rows=rows), "day_pnl", "loss_pct", "allowed")
    s = pdf.sort_values(["symbol", "rn"])
    own = s.groupby(["symbol", s["time"].dt.date])["pnl"].cumsum()
    total = 100 + s.groupby("symbol")["pnl"].cumsum()
    assert np.allclose(day["day_pnl"], own)
    loss = np.where((own < 0) & (total > 0), -own / total * 100, 0)
    assert np.allclose(day["loss_pct"], loss) and (day["allowed"].values == ((total <= 0) | (loss < 5)).values).all()


def test_metrics_do_not_depend_on_chunks(results):
    _, df = results
    whole = {r["symbol"]: r for r in X.trade_metrics(df, 50.0).collect()}
    hourly = {r["symbol"]: r for r in X.trade_metrics_h1(df).collect()}
    paths = {(r["symbol"], r["sim"]): r for r in MC.reshuffle(df, 3).collect()}
    for rows in (5, 12, 100):
        for one, all_rows in ((X.trade_metrics(df, 50.0, rows=rows), whole), (X.trade_metrics_h1(df, rows=rows), hourly)):
            for r in one.collect():
                assert np.allclose([float(v) for v in r[1:]], [float(v) for v in all_rows[r["symbol"]][1:]])
        for r in MC.reshuffle(df, 3, rows=rows).collect():
            assert np.allclose([float(v) for v in r[2:]], [float(v) for v in paths[(r["symbol"], r["sim"])][2:]])


def test_error_function(spark):
    import math

    from tidemark.functions.numbers import erfc, norm_cdf, two_sided_p

    x = [-40.0, -3.0, -0.4, -1e-9, 0.0, 0.3, 0.46875, 0.5, 2.0, 4.0, 4.1, 9.0, 26.0, 40.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(erfc("x")).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [math.erfc(v) for v in x[:-1]], rtol=1e-12, atol=1e-300)
    row = spark.range(1).select(norm_cdf(F.lit(1.959963984540054)), two_sided_p(F.lit(0.1), F.lit(400)), two_sided_p(F.lit(1.0), F.lit(9)), two_sided_p(F.lit(0.5), F.lit(2))).first()
    t = 0.1 * math.sqrt(398 / 0.99)
    assert abs(row[0] - 0.975) < 1e-12 and abs(row[1] - math.erfc(t / math.sqrt(2))) < 1e-13 and row[2] == 0.0 and row[3] is None


def _reshuffled(values, sims):
    """Every path walked in plain Python, in exact arithmetic where the values allow it."""
    from tidemark.functions.numbers import mix_values

    for sim in range(1, sims + 1):
        ids = np.arange(1, len(values) + 1)
        order = np.lexsort((ids, mix_values(sim, ids)))
        equity, peak, fall, ret = None, None, None, []
        for v in (values[i] for i in order):
            before = equity
            equity = v if equity is None else equity if v is None else equity + v
            if equity is None:
                continue
            peak = equity if peak is None else max(peak, equity)
            fall = max(fall or 0, peak - equity)
            if before is not None:
                ret.append((float(equity) - float(before)) / (abs(float(before)) + 1e-10))
        gain, loss = sum(v for v in values if v and v > 0), -sum(v for v in values if v and v < 0)
        sharpe = np.mean(ret) / (np.std(ret) + 1e-10) * 252**0.5 if ret and np.std(ret) > 0 else 0.0
        yield sim, equity, fall, sharpe, float(gain) / float(loss) if loss else 999.0


@pytest.mark.parametrize("kind", ["decimal(18,4)", "decimal(30,4)", "double", "long"])
@pytest.mark.parametrize("rows", [7, 10_000])
def test_reshuffled_paths_are_the_walks(spark, kind, rows):
    """Unknown results leave the equity as it is; sums beyond 64 bits stay exact."""
    from decimal import Decimal

    rng = np.random.default_rng(3)
    lists = {"mixed": [None if rng.random() < 0.2 else int(x) for x in rng.integers(-50, 60, 90)], "one": [5], "none": [None] * 12, "gains": [3, 4, 5]}
    if kind == "decimal(18,4)":
        lists["large"] = [Decimal(int(x)) for x in rng.integers(-9 * 10**13, 9 * 10**13, 60)] + [Decimal("90000000000000.1234")] * 40
    if kind == "decimal(30,4)":
        lists["large"] = [Decimal(int(x)) * 10**10 + Decimal("0.0001") for x in rng.integers(-9 * 10**13, 9 * 10**13, 60)]
    data = [(s, i + 1, None if v is None else str(v)) for s, values in lists.items() for i, v in enumerate(values)]
    df = settle(spark.createDataFrame(data, "symbol string, rn long, v string").select("symbol", "rn", F.col("v").cast(kind).alias("pnl")))
    got = {(r["symbol"], r["sim"]): r for r in MC.reshuffle(df, 3, rows=rows).collect()}
    assert len(got) == 3 * len(lists)
    for symbol, values in lists.items():
        for sim, final, fall, sharpe, pf in _reshuffled(values, 3):
            r = got[symbol, sim]
            assert r["final_pnl"] == (None if final is None else float(final)) and r["max_dd"] == (None if fall is None else float(fall))
            assert np.allclose([r["sharpe"], r["pf"]], [sharpe, pf], rtol=1e-6)


@pytest.mark.parametrize("rows", [7, None])
def test_bootstrap_totals_are_the_picked_results(spark, rows):
    from tidemark.functions.numbers import mix_values

    rng = np.random.default_rng(4)
    lists = {"mixed": [None if rng.random() < 0.2 else int(x) for x in rng.integers(-50, 60, 90)], "none": [None] * 5, "large": [9 * 10**13] * 50}
    data = [(s, i + 1, None if v is None else str(v)) for s, values in lists.items() for i, v in enumerate(values)]
    df = settle(spark.createDataFrame(data, "symbol string, rn long, v string").select("symbol", "rn", F.col("v").cast("decimal(18,4)").alias("pnl")))
    got = {(r["symbol"], r["sim"]): r["total"] for r in MC.bootstrap_totals(df, 4, 43, rows).collect()}
    want = {}
    for s, values in lists.items():
        ids = np.arange(1, len(values) + 1)
        for sim in range(1, 5):
            picked = [values[p] for p in mix_values(sim, ids, seed=43) % len(values)]
            want[s, sim] = float(sum(v for v in picked if v is not None)) if any(v is not None for v in picked) else None
    assert got == want


def test_array_hash_is_the_column_hash(spark):
    from tidemark.functions.numbers import mix, mix_values

    ids = [0, 1, 2, 65535, 2**31 - 2, 2**31 - 1, 2**31, 2**40 + 7]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(mix(F.lit(3), F.col("id"), seed=9)).collect()]
    assert got == mix_values(3, np.array(ids), seed=9).tolist()


def test_few_rows_are_shuffled_for_a_reshuffle(spark):
    """Draws travel packed: the pieces of a path are met by one shuffle of a few rows each, not by one row per draw."""
    n, sims = 4000, 5
    df = settle(spark.range(1, n + 1).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"), (F.col("id") % 7 - 3).cast("decimal(18,4)").alias("pnl")).coalesce(1))
    plan = MC.reshuffle(df, sims)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert MC.reshuffle(df, sims).count() == sims
