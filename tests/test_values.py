"""Known answers and boundary rules."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.numbers import mix, norm_cdf, norm_ppf, round_step, target_at
from tidemark.operators import indicators as I
from tidemark.operators import ml as M
from tidemark.operators import overfit as O
from tidemark.operators import projections as P
from tidemark.operators import search as S
from tidemark.operators import stats as T
from tidemark.operators import trades as X
from tidemark.operators.joins import external_positions, match_keywords, orphan_opens
from tidemark.session import settle
from tidemark.sources.journal import JOURNAL_COLUMNS, read_journal


def one(df, col):
    return df.select(col).first()[0]


def test_descriptions_of_plans_are_bounded(spark):
    df = settle(spark.range(1)).select(F.lit(bytes(1 << 20)).alias("table"))
    assert len(df._jdf.queryExecution().toString()) < 1 << 19
    assert len(df.first()["table"]) == 1 << 20


def test_normal_quantiles(spark):
    df = spark.range(1)
    for p, z in ((0.5, 0.0), (0.975, 1.959964), (0.025, -1.959964), (0.001, -3.090232), (0.9999, 3.719016)):
        assert abs(one(df, norm_ppf(F.lit(p))) - z) < 1e-5
    assert abs(one(df, norm_cdf(F.lit(1.959964))) - 0.975) < 1e-6
    assert one(df, norm_ppf(F.lit(0.0))) == -math.inf


def test_expected_max_sharpe_of_ten_trials(spark):
    assert abs(one(spark.range(1), O.expected_max_sharpe(F.lit(10.0), F.lit(1.0))) - 1.57) < 0.01
    assert one(spark.range(1), O.expected_max_sharpe(F.lit(10.0), F.lit(0.0))) == 0.0


def test_pbo_needs_four_trials(spark):
    rows = [("a", i, float(i), float(i)) for i in range(3)] + [("b", i, float(i), float(i)) for i in range(20)] + [("c", i, float(i), float(-i)) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, param_id long, wf_score double, oos_mean_pf double")
    got = {r["symbol"]: r["pbo"] for r in O.pbo(df).collect()}
    assert got["a"] is None and got["b"] < 0.2 and got["c"] > 0.8


def test_constant_price_rsi_is_100(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "S", "rn": np.arange(1, 41), "high": 5.0, "low": 5.0, "close": 5.0}))
    got = I.rsi(bars, 14).orderBy("rn").toPandas()["rsi"]
    assert got[:14].isna().all() and (got[14:] == 100.0).all()


def test_psi_of_equal_samples_is_zero(spark):
    v = spark.createDataFrame(pd.DataFrame({"symbol": "S", "v": np.random.default_rng(3).normal(size=500)}))
    assert abs(T.psi(v, v, ["symbol"], "v").first()["psi"]) < 1e-9
    few = v.limit(5)
    assert T.psi(v, few, ["symbol"], "v").first()["psi"] == 0.0


def test_ticket_outcomes_and_recent_stats(spark):
    """Ten tickets of one symbol, half +20 R and half -50 R, plus one of another symbol."""
    rows = []
    for i in range(10):
        rows.append((i, "A", "buy", 0.1, 100.0, 99.0, f"2024-01-{i + 1:02d} 00:00:00", None, "OPEN"))
        rows.append((i, None, None, None, None, None, None, 200.0 if i % 2 == 0 else -500.0, "CLOSE"))
    rows += [(99, "B", "buy", 0.1, 100.0, 99.0, "2024-01-01 00:00:00", None, "OPEN"), (99, None, None, None, None, None, None, 1.0, "CLOSE")]
    j = spark.createDataFrame(rows, "ticket long, symbol string, type string, volume double, entry_price double, sl double, entry_time string, pnl double, event string")
    meta = spark.createDataFrame([("A", 0.01, 1.0), ("B", 0.01, 1.0)], "symbol string, tick_size double, tick_value double")
    stats = X.recent_stats(X.ticket_r(j, meta), 50).collect()
    assert len(stats) == 1
    r = stats[0]
    assert (r["win_rate"], round(r["avg_win"], 6), round(r["avg_loss"], 6)) == (0.5, 20.0, 50.0)


def test_journal_keeps_good_rows_only(spark, tmp_path):
    good = "7,EURUSD,buy,0.10,1.1,1.0,1.2,2024-01-01 10:00:00,0.01,1.15,2024-01-02 10:00:00,12.50,5.0,CLOSE"
    blank = "8,EURUSD,buy,0.10,1.1,1.0,1.2,2024-01-01 10:00:00,0.01,,,,,OPEN"
    (tmp_path / "trades.csv").write_text("\n".join([",".join(JOURNAL_COLUMNS), good, blank, "9,EURUSD,buy", good + ",extra", '10,"A,B",' + good[9:]]) + "\n")
    ok, bad = read_journal(spark, str(tmp_path / "trades.csv"))
    rows = {r["ticket"]: r for r in ok.collect()}
    assert set(rows) == {7, 8, 10} and rows[10]["symbol"] == "A,B" and float(rows[7]["pnl"]) == 12.5 and rows[8]["pnl"] is None and rows[8]["event"] == "OPEN"
    assert bad.count() == 2


def test_orphans_and_external_positions(spark):
    j = spark.createDataFrame([(1, "OPEN"), (1, "CLOSE"), (2, "OPEN"), (3, "OPEN")], "ticket long, event string")
    active = spark.createDataFrame([(3,)], "ticket long")
    assert [r["ticket"] for r in orphan_opens(j, active).collect()] == [2]
    d = spark.createDataFrame([(1, 0), (5, 0), (6, 777), (6, 0), (0, 0)], "position_id long, magic int")
    assert [r["position_id"] for r in external_positions(d, j, 777).collect()] == [5]


def test_keywords_match_whole_words_of_any_script(spark):
    docs = spark.createDataFrame([(1, "Gold rises"), (2, "golden rule"), (3, "the Dow  Jones and dow jones index"), (4, "été gold-plated"), (5, "Régold")], "article_id long, text string")
    kw = spark.createDataFrame([("gold", "XAU"), ("dow jones", "US30"), ("été", "S")], "keyword string, symbol string")
    got = {(r["article_id"], r["symbol"]) for r in match_keywords(docs, kw).collect()}
    assert got == {(1, "XAU"), (3, "US30"), (4, "XAU"), (4, "S")}


def test_asset_rules(spark):
    s = spark.createDataFrame([("EURUSD.raw",), ("US30.raw",), ("ETHXYZ",), ("XAUXYZ",), ("AAPL",)], "symbol string")
    got = [r[0] for r in s.select(P.classify_symbol("symbol")).collect()]
    assert got == ["FOREX", "INDICES", "CRYPTO", "COMMOD", "STOCKS"]
    assert P.with_asset_class(s).first()["asset_class"] == "forex"


def test_scores(spark):
    df = spark.createDataFrame([(2.0, 100.0, 50.0, 16), (9.0, 100.0, 50.0, 2), (float("inf"), 10.0, 0.0, 9)], "pf double, ret double, dd double, n int")
    got = [r[0] for r in df.select(S.score_result(F.col("pf"), F.col("ret"), F.col("dd"), F.col("n"))).collect()]
    assert np.allclose(got, [2 * 2 * 1.2, -999, 0.0])


def test_plateau_takes_the_middle_row(spark):
    c = spark.createDataFrame([("S", f, 40, 1.0, 2.0, w, 10) for f, w in ((5, 9.5), (8, 10.0), (10, 9.2), (20, 3.0))] + [("T", 5, 40, 1.0, 2.0, -999.0, 0)], "symbol string, ema_fast int, ema_slow int, sl double, rr double, wf_score double, n_trades int")
    got = S.plateau_pick(c).collect()
    assert [(r["symbol"], r["ema_fast"]) for r in got] == [("S", 8)]


def test_purged_folds_have_gaps(spark):
    d = spark.createDataFrame(pd.DataFrame({"symbol": "S", "rn": np.arange(1, 101)}))
    s = M.purged_splits(d, 4, 5).toPandas()
    for _, g in s.groupby("fold"):
        assert g[g.role == "train"]["rn"].max() + 5 == g[g.role == "test"]["rn"].min() - 1
    assert s[(s.fold == 3) & (s.role == "test")]["rn"].max() == 100


def test_threshold_defaults_to_half(spark):
    p = spark.createDataFrame([(0.9, 1)] * 10, "prob double, label int")
    assert M.best_threshold(p).first()["threshold"] == 0.5
    assert M.best_threshold(p, min_trades=5).first()["threshold"] == 0.3


def test_small_helpers(spark):
    df = spark.range(1)
    assert one(df, round_step(F.lit(0.256), F.lit(0.01))) == 0.26
    assert one(df, target_at(F.array(F.lit(1.0), F.lit(2.0)), F.lit(7))) == 2.0
    w = one(df, P.parse_weights(F.lit("ml:0.4, spread:0.6,broken")))
    assert w == {"ml": 0.4, "spread": 0.6}
    draws = [r[0] for r in spark.range(2000).select(mix(F.lit(3), F.col("id")) % 10).collect()]
    assert min(np.bincount(draws, minlength=10)) > 150
