"""Walk-forward windows, candidate scores, parameter and weight search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, correlation, mix
from tidemark.operators import indicators as I
from tidemark.operators.chunks import CHUNK_ROWS, chunk_of, index_rows, rolling
from tidemark.operators.equity import folded
from tidemark.operators.labels import non_overlapping_trades
from tidemark.operators.orderstats import average_rank, quantiles, rank_table, with_average_rank
from tidemark.operators.ranking import top_k_per
from tidemark.operators.signals import cross_expr
from tidemark.operators.trailing import partial_level, trail
from tidemark.session import settle

REJECTED = -999.0


def _months(t: Column, n: Column) -> Column:
    """Timestamp shifted by whole months, day clipped to the month's end."""
    return t + F.make_ym_interval(F.lit(0), n.cast("int"))


def window_counts(bars: DataFrame, windows: DataFrame, min_is: int = 200, min_oos: int = 100) -> DataFrame:
    """Bars inside each window's in-sample and out-of-sample part; windows with too few are dropped.

    A symbol has a handful of windows, so every bar meets only those; counts are partial aggregates.
    """
    inside = lambda a, b: (F.col("time") >= F.col(a)) & (F.col("time") < F.col(b))
    g = bars.select("symbol", "time").join(windows, "symbol").groupBy("symbol", "window_id", "is_start", "is_end", "oos_start", "oos_end").agg(
        F.count_if(inside("is_start", "is_end")).alias("n_is"), F.count_if(inside("oos_start", "oos_end")).alias("n_oos")
    )
    return g.where((F.col("n_is") >= min_is) & (F.col("n_oos") >= min_oos))


def wf_windows(bars: DataFrame, n: int = 4, is_months: int = 24, oos_months: int = 6) -> DataFrame:
    """Rolling in-sample / out-of-sample windows ending at each symbol's last bar, newest first."""
    edge = bars.groupBy("symbol").agg(F.max("time").alias("end"))
    w = edge.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = w.withColumn("oos_end", _months(F.col("end"), -F.col("window_id") * oos_months))
    w = w.withColumn("oos_start", _months(F.col("oos_end"), F.lit(-oos_months)))
    return w.select("symbol", "window_id", _months(F.col("oos_start"), F.lit(-is_months)).alias("is_start"), F.col("oos_start").alias("is_end"), "oos_start", "oos_end")


def cpcv_windows(bars: DataFrame, n_paths: int = 15, is_months: int = 24, oos_months: int = 6, purge_months: int = 1) -> DataFrame:
    """Windows rolled month by month from the first bar, with a purge gap; needs enough history for one path."""
    edge = bars.groupBy("symbol").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    days = F.datediff("end", "start")
    edge = edge.withColumn("months", F.greatest(F.floor(days / 30), F.lit(1)).cast("int"))
    last = F.greatest(F.lit(0), F.col("months") - is_months - oos_months - purge_months)
    w = edge.where(F.col("months") >= is_months + oos_months + purge_months).withColumn("step", F.explode(F.sequence(F.lit(0), last)))
    at = lambda k: _months(F.col("start"), F.least(F.col("step") + k, F.col("months")))
    w = w.select(
        "symbol", F.col("step").alias("window_id"), at(0).alias("is_start"), at(is_months).alias("is_end"), at(is_months + purge_months).alias("oos_start"),
        at(is_months + purge_months + oos_months).alias("oos_end"), "end",
    )
    ok = w.where((F.col("oos_start") < F.col("oos_end")) & (F.col("oos_start") < F.col("end"))).drop("end")
    return top_k_per(ok, ["symbol"], ["window_id"], n_paths).drop("rank")


def bar_folds(bars: DataFrame, train_bars: int = 3 * 365 * 24, test_bars: int = 9 * 30 * 24, min_start: int = 2000) -> DataFrame:
    """Row-count folds per symbol; one 10 % / 70 % / 100 % fold where the history is too short."""
    edge = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    start = F.greatest(F.lit(min_start), F.floor(F.col("n") * 0.2))
    last = F.ceil((F.col("n") - start - train_bars - test_bars) / test_bars) - 1
    folds = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda k: F.struct(
        k.alias("fold"), (start + k * test_bars).alias("train_start"), (start + k * test_bars + train_bars).alias("train_end"),
        (start + k * test_bars + train_bars + test_bars).alias("test_end"),
    )))
    short = F.array(F.struct(F.lit(0).cast("long").alias("fold"), F.floor(F.col("n") * 0.1).alias("train_start"), F.floor(F.col("n") * 0.7).alias("train_end"), F.col("n").alias("test_end")))
    return edge.select("symbol", F.explode(F.coalesce(folds, short)).alias("f")).select("symbol", "f.*")


def score_result(pf: Column, ret: Column, dd: Column, n: Column) -> Column:
    """min(PF, 3) * |return / drawdown| * (1 + 0.05 sqrt(n)); rejected below three trades."""
    calmar = F.when(dd > 0, F.abs(ret / dd)).otherwise(0.0)
    return F.when(n < 3, REJECTED).otherwise(F.least(F.coalesce(pf, F.lit(0.0)), F.lit(3.0)) * calmar * (1 + 0.05 * F.sqrt(n)))


def score_result_alt(pf: Column, ret: Column, dd: Column, wr: Column, n: Column) -> Column:
    """Alternate score: return less 30 % drawdown, weighted by capped PF and by win-rate and PF bands."""
    p = F.least(F.coalesce(pf, F.lit(0.0)), F.lit(3.0))
    base = ret - dd * 0.3
    base = F.when((base < 0) & (p > 1), base * 0.5).otherwise(base)
    wr_mult = F.when(wr.between(0.50, 0.55), 1.15).when(wr > 0.60, 1 - F.least(F.lit(0.7), (wr - 0.60) * 5)).otherwise(1.0)
    pf_mult = F.when(p.between(1.2, 1.6), 1.15).when(p > 2.0, F.greatest(F.lit(0.3), 1 - (p - 2.0) * 0.3)).otherwise(1.0)
    return F.when(n < 3, REJECTED).otherwise(base * p * wr_mult * pf_mult)


def score_wf(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean in-sample score, halved by any out-of-sample PF below 0.8, raised 20 % when all reach 1 (is_score, oos_pf)."""
    g = windows.groupBy(*by).agg(F.avg("is_score").alias("m"), F.bool_or(F.col("oos_pf") < 0.8).alias("weak"), F.bool_and(F.col("oos_pf") >= 1.0).alias("strong"))
    value = F.col("m") * F.when(F.col("weak"), 0.5).otherwise(1.0) * F.when(F.col("strong"), 1.2).otherwise(1.0)
    return g.select(*by, value.alias("wf_score"))


def score_wf_alt(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean alternate score times a penalty per window that degrades out of sample (is_alt, oos_alt, oos_pf, oos_n)."""
    deg = F.when((F.col("is_alt") > 0) & (F.col("oos_n") >= 3), (F.col("is_alt") - F.col("oos_alt")) / F.greatest(F.abs("is_alt"), F.lit(0.01)))
    factor = F.when(deg > 0.50, F.greatest(F.lit(0.1), 1 - (deg - 0.30) * 2)).otherwise(1.0)
    g = windows.groupBy(*by).agg(F.avg("is_alt").alias("m"), F.product(factor).alias("pen"), F.count_if(F.col("oos_pf") >= 1.0).alias("good"))
    bonus = F.when(F.col("good") >= 2, 1.15).when(F.col("good") == 0, 0.5).otherwise(1.0)
    return g.select(*by, (F.col("m") * F.col("pen") * bonus).alias("wf_alt"))


def score_cpcv(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median plus lower quartile of the out-of-sample scores, gated by the lower quartile of their PF.

    A parameter set has at most a few dozen paths, so the built-in exact percentile is used.
    """
    ok = F.col("oos_score") > REJECTED
    robust = F.col("oos_n") >= 3
    g = windows.groupBy(*by).agg(
        F.count_if(ok).alias("k"), F.percentile(F.when(ok, F.col("oos_score")), 0.25).alias("p25"), F.percentile(F.when(ok, F.col("oos_score")), 0.5).alias("p50"),
        F.count_if(robust).alias("kr"), F.percentile(F.when(robust, F.col("oos_pf")), 0.25).alias("pf25"), F.bool_and(F.when(robust, F.col("oos_pf") >= 1.0)).alias("all_ok"),
    )
    gated = (F.col("kr") >= 3) & (F.col("pf25") >= 1.1)
    value = F.when(F.col("k") < 3, REJECTED).when(F.coalesce(gated, F.lit(False)), F.col("p50") * F.when(F.col("all_ok"), 1.2).otherwise(1.0) + F.col("p25")).otherwise(
        (F.col("p50") * 0.5 + F.col("p25")) * 0.25
    )
    return g.select(*by, value.alias("cpcv_score"))


def stability(cands: DataFrame, score: str = "wf_score", width: float = 0.005) -> DataFrame:
    """1 / (1 + cv) of the best scores of MA pairs with nearly the same fast/slow ratio; 1 for a lone pair.

    Pairs meet through ratio buckets of the tolerance's width and their neighbours, not through a theta join.
    """
    best = cands.groupBy("symbol", "ema_fast", "ema_slow").agg(F.max(score).alias("__best"))
    best = best.withColumn("ratio", F.col("ema_fast") / F.col("ema_slow"))
    cell = F.floor(F.col("ratio") / width)
    left = best.select("symbol", "ema_fast", "ema_slow", F.round("ratio", 4).alias("r0"), F.explode(F.sequence(F.floor(F.round("ratio", 4) / width) - 1, F.floor(F.round("ratio", 4) / width) + 1)).alias("cell"))
    right = best.select("symbol", F.col("ratio").alias("r1"), "__best", cell.alias("cell"))
    near = left.join(right, ["symbol", "cell"]).where(F.abs(F.col("r1") - F.col("r0")) < width)
    g = near.groupBy("symbol", "ema_fast", "ema_slow").agg(F.count(F.lit(1)).alias("k"), F.stddev_pop("__best").alias("sd"), F.avg("__best").alias("m"))
    value = F.when(F.col("k") < 2, 1.0).otherwise(1 / (1 + F.col("sd") / F.greatest(F.abs("m"), F.lit(0.01))))
    return cands.join(g.select("symbol", "ema_fast", "ema_slow", value.alias("stability")), ["symbol", "ema_fast", "ema_slow"], "left")


def plateau_pick(cands: DataFrame, score: str = "wf_score", pct: float = 0.90, min_trades: int = 3) -> DataFrame:
    """Middle row (by ema_fast) of each symbol's candidates within `pct` of the best; the best one if none qualifies."""
    edge = cands.groupBy("symbol").agg(F.max(score).alias("__best"))
    c = cands.join(edge, "symbol").where(F.col("__best") > REJECTED)
    tie = ["ema_slow", "sl", "rr"]
    on_top = c.where((F.col(score) >= F.col("__best") * pct) & (F.col("n_trades") >= min_trades))
    single = top_k_per(c.join(on_top.select("symbol").distinct(), "symbol", "left_anti"), ["symbol"], [F.desc(score), "ema_fast", *tie], 1).drop("rank")
    plateau = on_top.unionByName(single)
    w = Window.partitionBy("symbol")  # the plateau of one symbol's grid
    ranked = plateau.withColumn("__k", F.row_number().over(w.orderBy("ema_fast", *tie))).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__k") == F.floor(F.col("__n") / 2) + 1).drop("__k", "__n", "__best")


def param_diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """Changed or added settings: (symbol, key, old, new) beyond a relative tolerance of 1e-9."""
    c = current.select("symbol", "key", F.col("value").alias("old"))
    n = new.select("symbol", "key", F.col("value").alias("new")).where(F.col("new").isNotNull())
    same = F.abs(F.col("old") - F.col("new")) < 1e-9 * F.greatest(F.abs("new"), F.lit(0.01))
    return n.join(c, ["symbol", "key"], "left").where(~F.coalesce(same, F.lit(False))).select("symbol", "key", "old", "new")


def sweep_rank(cands: DataFrame, n: int = 30) -> DataFrame:
    """Candidates with enough trades and a finite positive walk-forward score, ranked by it across symbols.

    The input holds one best row per symbol.
    """
    ok = cands.where((F.col("n_trades") >= n) & (F.col("wf_score") > 0) & (F.col("wf_score") < float("inf")))
    return ok.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wf_score"), "symbol")))


# --- grid search ----------------------------------------------------------------------------------------------------


def grid_trades(bars: DataFrame, grid: DataFrame, kind: str = "kama", rows: int | None = None) -> DataFrame:
    """Non-overlapping trades of every grid row (param_id, ema_fast, ema_slow, sl, rr).

    Averages are computed once per distinct period, crosses once per distinct pair; only then are stop and target
    multiples joined on. Stops are ATR / sl, targets that distance times rr.
    """
    pairs = [tuple(r) for r in grid.select("ema_fast", "ema_slow").distinct().orderBy("ema_fast", "ema_slow").collect()]  # a parameter axis
    periods = sorted({p for pair in pairs for p in pair})
    parts = [I.ma_part(f"ma{n}", n, kind) for n in periods] + [I.atr_series_part("atr", 14)]
    s = settle(I.scan_parts(bars, parts, rows=rows))

    def build(d, w):
        lag = {n: F.lag(f"ma{n}").over(w) for n in periods}
        d = d.select("*", *[lag[n].alias(f"p{n}") for n in periods])
        each = [
            F.struct(F.lit(f).alias("ema_fast"), F.lit(g).alias("ema_slow"), cross_expr(F.col(f"ma{f}"), F.col(f"ma{g}"), F.col(f"p{f}"), F.col(f"p{g}")).alias("signal"))
            for f, g in pairs
        ]
        return d.withColumn("x", F.explode(F.filter(F.array(*each), lambda e: e["signal"].isNotNull())))

    sig = rolling(s, build, back=1, rows=rows).where((F.col("atr") > 0) & (F.col("rn") > F.greatest(F.col("x.ema_slow"), F.lit(14)) + 50))
    sig = sig.select("symbol", "rn", "close", "atr", "x.*").join(grid, ["ema_fast", "ema_slow"])
    side = F.when(F.col("signal") == "buy", 1.0).otherwise(-1.0)
    dist = F.col("atr") / F.col("sl")
    sig = sig.select("symbol", "param_id", "rn", "signal", "close", (F.col("close") - side * dist).alias("sl"), (F.col("close") + side * dist * F.col("rr")).alias("tp"))
    return non_overlapping_trades(settle(sig), s.select("symbol", "rn", "time", "high", "low", "close"))


def candidate_metrics(trades: DataFrame, keys: Sequence[str] = ("symbol", "param_id"), rows: int | None = None) -> DataFrame:
    """Return, drawdown, PF, win rate and count per candidate (a candidate's trades are at most one per bar).

    Trades are folded by ranges of exit bars, so a candidate with any number of trades is many small windows.
    """
    pnl = F.col("pnl")
    also = {
        "n_trades": ("sum", F.lit(1)), "__wins": ("sum", F.when(pnl > 0, 1).otherwise(0)), "__gain": ("sum", F.when(pnl > 0, pnl)), "__loss": ("sum", F.when(pnl < 0, pnl)),
    }
    g = folded(trades, pnl, keys, F.floor(F.col("exit_rn") / (rows or CHUNK_ROWS)), ["exit_rn", "entry_rn"], also)
    loss = F.coalesce(F.abs("__loss"), F.lit(0.0))
    return g.select(
        *keys, F.when(loss > 0, F.coalesce("__gain", F.lit(0.0)) / loss).otherwise(999.0).alias("pf"), F.col("total").alias("ret"), F.col("fall").alias("dd"),
        (F.col("__wins") / F.col("n_trades")).alias("wr"), "n_trades",
    )


def grid_search(bars: DataFrame, grid: DataFrame, windows: DataFrame, kind: str = "kama", rows: int | None = None) -> DataFrame:
    """Walk-forward score of every (symbol, grid row): trades -> window parts -> metrics -> score, one lineage."""
    trades = settle(grid_trades(bars, grid, kind, rows))
    inside = trades.join(windows, "symbol")
    t = F.col("exit_time")
    part = F.when((t >= F.col("is_start")) & (t < F.col("is_end")), "is").when((t >= F.col("oos_start")) & (t < F.col("oos_end")), "oos")
    m = candidate_metrics(inside.withColumn("part", part).where(F.col("part").isNotNull()), ["symbol", "param_id", "window_id", "part"])
    m = m.withColumn("score", score_result(F.col("pf"), F.col("ret"), F.col("dd"), F.col("n_trades")))
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = m.groupBy("symbol", "param_id", "window_id").agg(
        F.coalesce(pick("is", "score"), F.lit(REJECTED)).alias("is_score"), F.coalesce(pick("oos", "pf"), F.lit(0.0)).alias("oos_pf"),
        *[pick("is", c).alias(c) for c in ("pf", "ret", "dd", "wr", "n_trades")],
    )
    scored = score_wf(wide, ["symbol", "param_id"])
    newest = wide.groupBy("symbol", "param_id").agg(
        F.min_by(F.struct("pf", "ret", "dd", "wr", "n_trades"), "window_id").alias("x"), F.avg("oos_pf").alias("oos_mean_pf")
    )
    out = scored.join(newest, ["symbol", "param_id"]).select("symbol", "param_id", "wf_score", "oos_mean_pf", "x.*")
    return out.join(grid, "param_id")


def two_phase(bars: DataFrame, pairs: DataFrame, exits: DataFrame, windows: DataFrame, kind: str = "kama") -> DataFrame:
    """Phase 1 ranks MA pairs at fixed exits, phase 2 runs the exit grid around each symbol's best two pairs."""
    number = lambda df: df.withColumn("param_id", F.row_number().over(Window.orderBy(*df.columns)))  # a parameter grid
    fixed = number(pairs.select("ema_fast", "ema_slow").withColumn("sl", F.lit(1.5)).withColumn("rr", F.lit(2.0)))
    first = settle(grid_search(bars, fixed, windows, kind))
    best = top_k_per(first, ["symbol"], [F.desc("wf_score"), "ema_fast", "ema_slow"], 2).select("symbol", "ema_fast", "ema_slow")
    chosen = settle(best.select("ema_fast", "ema_slow").distinct())
    second = grid_search(bars, settle(number(chosen.crossJoin(exits.select("sl", "rr")))), windows, kind)
    return second.join(best, ["symbol", "ema_fast", "ema_slow"])


def screen(bars: DataFrame, profiles: DataFrame, windows: DataFrame) -> DataFrame:
    """Best profile per symbol by profit factor over its newest window."""
    out = grid_search(bars, profiles, windows)
    return top_k_per(out, ["symbol"], [F.desc("pf"), F.desc("n_trades"), "param_id"], 1).drop("rank")


def tune_exits(positions: DataFrame, bars: DataFrame, grid: DataFrame, keys=("symbol", "day_no"), top: int = 10) -> DataFrame:
    """Exit-parameter sweep over positions (``trailing.with_start``) and numbered bars with atr, ranked by Calmar.

    Every position is followed per grid row (param_id, target, ch_mult): half closes at the target fraction, the rest at the
    trailing stop or at the last bar. Positions are followed only as long as they are open (``trailing.trail``).
    """
    p = positions.crossJoin(F.broadcast(grid.select("param_id", "target", "ch_mult")))  # the parameter axes
    level = partial_level(F.col("target"))
    g = trail(p, bars, F.col("ch_mult"), [*keys, "param_id"], level)
    side = F.when(F.col("type") == "buy", 1.0).otherwise(-1.0)
    scaled = F.col("partial_time").isNotNull()
    move = lambda x: (x - F.col("price_open")) * side
    g = g.where(F.col("last_time") > F.col("time"))  # a position without a bar after its entry has no result
    g = g.withColumn("exit", F.coalesce("exit_stop", "last_close")).withColumn("exit_time", F.col("last_time"))
    g = g.withColumn("pnl", F.when(scaled, 0.5 * move(level) + 0.5 * move(F.col("exit"))).otherwise(move(F.col("exit"))))
    g = g.withColumns({"scaled": F.when(scaled, 1).otherwise(0), "trailed": F.when(F.col("exit_rn").isNotNull(), 1).otherwise(0)})
    pair = ["symbol", "param_id"]
    g = settle(index_rows(g, pair, [F.to_date("exit_time")], ["exit_time", *[k for k in keys if k != "symbol"]]))
    also = {"trades": ("sum", F.lit(1)), "__wins": ("sum", F.when(F.col("pnl") > 0, 1).otherwise(0)), "scale_out": ("sum", F.col("scaled")), "chandelier": ("sum", F.col("trailed"))}
    m = folded(g, F.col("pnl"), [*pair, "target", "ch_mult"], chunk_of(), ["rn"], also)
    m = m.select(*pair, "target", "ch_mult", "trades", F.col("total").alias("ret"), F.col("fall").alias("max_dd"), (F.col("__wins") / F.col("trades") * 100).alias("win_rate"), "scale_out", "chandelier")
    m = m.withColumn("calmar", F.when(F.col("max_dd") > 0, F.abs(F.col("ret") / F.col("max_dd"))).otherwise(0.0))
    # Equal ratios differ in their last digits by the order of sums, so ranks go by nine of them.
    return top_k_per(m, ["symbol"], [F.desc(F.round("calmar", 9)), "param_id"], top)


# --- scoring-weight search ------------------------------------------------------------------------------------------


def weight_sets(spark, components: Sequence[str], n: int, baseline: Mapping[str, float], alphas=(0.5, 0.8, 1.0, 1.5, 2.0), seed: int = 42) -> DataFrame:
    """`n` reproducible random weight sets on the simplex plus the CURRENT and EQUAL rows.

    Exponential draws from a hash give a flat Dirichlet; the batch's alpha sharpens or flattens them.
    """
    ids = spark.range(1, n + 1).withColumnRenamed("id", "weight_id")
    alpha = F.element_at(F.array(*[F.lit(a) for a in alphas]), (F.col("weight_id") % len(alphas) + 1).cast("int"))
    raw = [F.pow(-F.log((mix(F.col("weight_id"), i, seed=seed) + 1) / 2147483648.0), 1.0 / alpha).alias(c) for i, c in enumerate(components)]
    draws = ids.select("weight_id", *raw)
    total = sum((F.col(c) for c in components), F.lit(0.0))
    draws = draws.select("weight_id", *[(F.col(c) / total).alias(c) for c in components], F.lit("").alias("label"))
    bsum = sum(baseline.get(c, 0.0) for c in components)
    fixed = spark.createDataFrame(
        [(-1, *[baseline.get(c, 0.0) / bsum for c in components], "CURRENT"), (0, *[1.0 / len(components)] * len(components), "EQUAL")],
        "weight_id long, " + ", ".join(f"`{c}` double" for c in components) + ", label string",
    )
    return draws.unionByName(fixed)


def weight_search(scored: DataFrame, weights: DataFrame, components: Sequence[str], fwd: str = "fwd_24", batch: int = 64) -> DataFrame:
    """IC, quartile win rates and quartile spread of every weight set over all scored rows.

    Sets go through the rows `batch` at a time, so sets x rows is never held at once; ranks of one set are cut into
    value ranges, so no task sorts a whole set.
    """
    known = scored.where(F.col(fwd).isNotNull())
    ranked = settle(with_average_rank(known.select("symbol", "time", *components, fwd), [], fwd, "__ry"))
    w = weights.select("weight_id", "label", *[F.col(c).alias(f"w_{c}") for c in components])
    packed = w.select("weight_id", F.array(*[f"w_{c}" for c in components]).alias("w"))
    rounds = max(1, -(-packed.count() // batch))
    out = None
    for i in range(rounds):
        part = settle(_weighted(ranked, packed.where(F.pmod("weight_id", F.lit(rounds)) == i), components, fwd))
        out = part if out is None else out.unionByName(part)
    return combined_score(out.join(weights, "weight_id"))


def _weighted(ranked: DataFrame, packed: DataFrame, components: Sequence[str], fwd: str) -> DataFrame:
    """Statistics of one batch of weight sets."""
    comp = ranked.crossJoin(F.broadcast(packed)).select(  # a batch has a bounded number of sets
        "weight_id", "symbol", "time", fwd, "__ry", F.round(sum((F.col(c) * F.col("w")[i] for i, c in enumerate(components)), F.lit(0.0)), 12).alias("composite")
    )
    comp = settle(comp)
    ranks = rank_table(comp, ["weight_id"], "composite")
    edges = quantiles(comp, ["weight_id"], "composite", {"__hi": 0.75, "__lo": 0.25})
    ties = Window.partitionBy("weight_id", "composite").orderBy("time", "symbol")
    r = comp.join(ranks, ["weight_id", "composite"]).join(edges, "weight_id")
    r = r.withColumns({"__rx": average_rank(), "__first": F.col("below") + F.row_number().over(ties)})
    at = lambda p: 1 + (F.col("total") - 1) * p
    win = F.when(F.col(fwd) > 0, 1.0).otherwise(0.0)
    return r.groupBy("weight_id").agg(
        F.round(F.coalesce(correlation("__rx", "__ry"), F.lit(0.0)), 4).alias("IC"),
        F.round(F.avg(F.when(F.col("composite") >= F.col("__hi"), win)), 4).alias("top_win_rate"),
        F.round(F.avg(F.when(F.col("composite") <= F.col("__lo"), win)), 4).alias("bot_win_rate"),
        F.round(F.avg(F.when(F.col("__first") > at(0.75), F.col(fwd))) - F.avg(F.when(F.col("__first") <= at(0.25), F.col(fwd))), 6).alias("spread_q4_q1"),
    )


def combined_score(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half min-max IC plus half min-max top win rate (0 when either does not vary)."""
    g = (results.groupBy(*by) if by else results.groupBy()).agg(
        F.min("IC").alias("__i0"), F.max("IC").alias("__i1"), F.min("top_win_rate").alias("__w0"), F.max("top_win_rate").alias("__w1")
    )
    r = results.join(g, list(by)) if by else results.crossJoin(F.broadcast(g))
    varied = (F.col("__i1") > F.col("__i0")) & (F.col("__w1") > F.col("__w0"))
    value = 0.5 * (F.col("IC") - F.col("__i0")) / (F.col("__i1") - F.col("__i0")) + 0.5 * (F.col("top_win_rate") - F.col("__w0")) / (F.col("__w1") - F.col("__w0"))
    return r.withColumn("combined", F.when(varied, value).otherwise(0.0)).drop("__i0", "__i1", "__w0", "__w1")


def pick_weights(results: DataFrame) -> DataFrame:
    """The best random weight set by IC, combined score, win rate and the weighted objective (lowest id on ties)."""
    c = results.where(F.coalesce("label", F.lit("")) == "")
    objective = 0.4 * F.col("IC") + 0.3 * F.col("top_win_rate") + 0.3 * F.greatest("spread_q4_q1", F.lit(0.0))
    c = c.withColumn("objective", objective).withColumn("__neg", -F.col("weight_id"))
    best = lambda k: F.max(F.struct(F.col(k), F.col("__neg")))
    g = c.agg(*[best(k).alias(k) for k in ("IC", "combined", "top_win_rate", "objective")])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("criterion"), (-F.col(f"{k}.__neg")).alias("weight_id"), F.col(f"{k}.{k}").alias("value")) for name, k in (
        ("best_by_IC", "IC"), ("best_by_combined", "combined"), ("best_by_win_rate", "top_win_rate"), ("best_by_objective", "objective"))]))
    return g.select(rows.alias("r")).select("r.*")


def weight_cv(scored: DataFrame, weights: DataFrame, components: Sequence[str], splits: int = 5, top: int = 10, fwd: str = "fwd_24") -> DataFrame:
    """Chronological folds: the best weight sets of everything before a fold, evaluated on the fold.

    One pass per fold over the weight table; the number of folds is a parameter.
    """
    known = settle(scored.where(F.col(fwd).isNotNull()))
    numbered = settle(index_rows(known.select("symbol", "time", *components, fwd), [], [F.year("time"), F.dayofyear("time")], ["time", "symbol"], "__row"))
    size = numbered.count() // splits
    out = None
    for fold in range(1, splits):
        train = numbered.where(F.col("__row") <= fold * size)
        test = numbered.where((F.col("__row") > fold * size) & (F.col("__row") <= (fold + 1) * size))
        found = settle(weight_search(train, weights, components, fwd))
        picks = None
        for label in ("IC", "combined"):
            best = top_k_per(found.withColumn("__g", F.lit(1)), ["__g"], [F.desc(label), "weight_id"], top).select(
                F.lit(fold).alias("fold"), F.lit(label).alias("chosen_by"), "rank", "weight_id", F.col("IC").alias("train_IC"), F.col("top_win_rate").alias("train_top_win"), *components
            )
            picks = best if picks is None else picks.unionByName(best)
        picks = settle(picks)
        seen = weight_search(test, weights.join(picks.select("weight_id").distinct(), "weight_id"), components, fwd)
        part = picks.join(seen.select("weight_id", F.col("IC").alias("test_IC"), F.col("top_win_rate").alias("test_top_win")), "weight_id")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ic_gap", F.col("train_IC") - F.col("test_IC"))
