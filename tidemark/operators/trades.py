"""Trade, journal and portfolio aggregation.

Trades are numbered per symbol first (``index_rows``); everything ordered runs on row chunks, everything else is a
partial aggregation. Money is kept in exact decimals until the last step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, pnl_currency
from tidemark.functions.times import epoch_seconds, trading_day, week_start
from tidemark.operators.chunks import CHUNK_ROWS, chunk_of, rolling, running
from tidemark.operators.equity import folded, moments, path, spread
from tidemark.session import settle



def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def wins(c: str = "pnl") -> Column:
    return F.sum(F.when(F.col(c) > 0, F.col(c)))


def profit_factor(c: str = "pnl", when_none: float = float("inf")) -> Column:
    """Gross win over gross loss (losses are negative results)."""
    loss = F.abs(F.sum(F.when(F.col(c) < 0, F.col(c))))
    gain = F.coalesce(_d(wins(c)), F.lit(0.0))
    return F.when(F.coalesce(_d(loss), F.lit(0.0)) > 0, gain / _d(loss)).otherwise(F.lit(when_none))


def outcome_stats(c: str = "pnl") -> list[Column]:
    """n, total, win rate, mean win, mean loss (losses include zero results)."""
    return [
        F.count(F.lit(1)).alias("n_trades"),
        _d(F.sum(c)).alias("total"),
        (F.count_if(F.col(c) > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.coalesce(_d(F.sum(F.when(F.col(c) > 0, F.col(c)))) / F.count_if(F.col(c) > 0), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.abs(_d(F.sum(F.when(F.col(c) <= 0, F.col(c))))) / F.count_if(F.col(c) <= 0), F.lit(0.0)).alias("avg_loss"),
    ]


def equity_curve(trades: DataFrame, base: float, by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    """Equity after every trade, its running peak and the drawdown in money and percent (peak starts at `base`)."""
    start = F.lit(base).cast("decimal(18,4)")
    out = path(trades, F.col("pnl"), by, rows, "cum_pnl", "__top").withColumn("equity", F.col("cum_pnl") + start)
    peak = F.greatest(F.col("__top") + start, start.cast("decimal(38,4)"))
    return (
        out.withColumn("peak", peak).drop("__top")
        .withColumn("drawdown", F.col("peak") - F.col("equity"))
        .withColumn("drawdown_pct", _d("drawdown") / F.greatest(_d("peak"), F.lit(TINY)) * 100)
    )


def _outcome_parts() -> dict[str, tuple[str, Column]]:
    """Sums from which `_outcome` takes what ``outcome_stats`` and ``profit_factor`` give."""
    pnl = F.col("pnl")
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "n_trades": ("sum", F.lit(1)), "__wins": ("sum", one(pnl > 0)), "__others": ("sum", one(pnl <= 0)), "__gain": ("sum", F.when(pnl > 0, pnl)),
        "__rest": ("sum", F.when(pnl <= 0, pnl)), "__loss": ("sum", F.when(pnl < 0, pnl)),
    }


def _outcome(when_none: float = float("inf")) -> list[Column]:
    gain, loss = F.coalesce(_d("__gain"), F.lit(0.0)), F.coalesce(F.abs(_d("__loss")), F.lit(0.0))
    return [
        "n_trades", _d("total").alias("total"), (F.col("__wins") / F.col("n_trades")).alias("win_rate"), F.coalesce(_d("__gain") / F.col("__wins"), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.abs(_d("__rest")) / F.col("__others"), F.lit(0.0)).alias("avg_loss"), F.when(loss > 0, gain / loss).otherwise(F.lit(when_none)).alias("profit_factor"),
        _d("fall").alias("max_dd"),
    ]


def trade_metrics(trades: DataFrame, base: float, by: Sequence[str] = ("symbol",), step: int = 6, rows: int | None = None) -> DataFrame:
    """Counts, profit factor, drawdown, Calmar, and the Sharpe of every `step`-th equity point.

    The drawdown does not depend on `base`. A step of equity is the sum of the `step` results it spans, so the sampled
    points need no equity: groups of `step` rows are summed, and only whole groups count.
    """
    by = list(by)
    size = (rows or CHUNK_ROWS) // step * step or step
    # Chunks end at sampled points (rows 1, 1 + step, ...), so that no group of steps is cut.
    chunk = F.floor((F.col("rn") + step - 2) / size).cast("long")
    in_step = Window.partitionBy(*by, "chunk").orderBy("rn").rowsBetween(-(step - 1), 0)
    marked = trades.select(*by, "rn", "pnl", chunk.alias("chunk")).withColumn("__step", F.sum("pnl").over(in_step))
    sampled = F.when(((F.col("rn") - 1) % step == 0) & (F.col("rn") > 1), F.col("__step"))
    g = folded(marked, F.col("pnl"), by, F.col("chunk"), ["rn"], _outcome_parts() | moments(sampled, "__d"))
    mean, dev = spread("__d")
    g = g.select(*by, *_outcome(), mean.alias("__m"), dev.alias("__s"))
    sharpe = F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * (252**0.5)).otherwise(0.0)
    return g.withColumn("sharpe", sharpe).withColumn("calmar", _calmar()).drop("__m", "__s")


def trade_metrics_h1(trades: DataFrame, by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    """Metric set annualised on hourly bars; a missing loss side gives profit factor 999."""
    by = list(by)
    per_year = 365.25 * 24
    g = folded(trades.select(*by, "rn", "pnl"), F.col("pnl"), by, chunk_of(rows), ["rn"], _outcome_parts() | moments(F.col("pnl"), "__p"))
    g = g.select(*by, *_outcome(999.0), spread("__p")[1].alias("__s"))
    annual = F.col("total") / ((F.col("n_trades") + 1) / per_year)
    sharpe = F.when(F.col("__s") > 0, annual / F.col("__s") * per_year**0.5).otherwise(0.0)
    return g.withColumn("sharpe", sharpe).withColumn("calmar", _calmar()).drop("__s")


def _calmar() -> Column:
    return F.when(F.col("max_dd") > 0, F.abs(F.col("total") / F.col("max_dd"))).otherwise(0.0)


def by_regime(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), _d(F.sum("pnl")).alias("pnl")
    )


def by_exit_reason(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.coalesce("exit_reason", F.lit("UNKNOWN")).alias("exit_reason")).agg(F.count(F.lit(1)).alias("n"))


def weekly_summary(closes: DataFrame, now, key: str = "symbol") -> DataFrame:
    """Totals since Monday 00:00 (UTC+5 wall clock) of the week of `now`, one row per `key` plus an ALL row."""
    cutoff = F.date_trunc("week", F.lit(now).cast("timestamp")).cast("timestamp_ntz")
    week = closes.where(F.col("exit_time") >= cutoff)
    trade = F.struct("pnl", "ticket", "line")
    stats = week.rollup(key).agg(
        F.count(F.lit(1)).alias("trades"),
        _d(F.sum("pnl")).alias("total_pnl"),
        (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("wr"),
        F.coalesce(_d(wins()), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.abs(_d(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl"))))), F.lit(0.0)).alias("gross_loss"),
        F.count_if(F.col("pnl") > 0).alias("__w"),
        F.max(trade).alias("__best"),
        F.min(trade).alias("__worst"),
        F.grouping(key).alias("__all"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return stats.select(
        F.when(F.col("__all") == 1, "ALL").otherwise(F.col(key)).alias(key), "trades", "total_pnl", "wr",
        ratio(F.col("gross_win"), F.col("gross_loss")).alias("pf"),
        ratio(F.col("gross_win"), F.col("__w")).alias("avg_win"),
        ratio(F.col("gross_loss"), F.col("trades") - F.col("__w")).alias("avg_loss"),
        F.col("__best.ticket").alias("best_ticket"), _d("__best.pnl").alias("best_pnl"),
        F.col("__worst.ticket").alias("worst_ticket"), _d("__worst.pnl").alias("worst_pnl"),
    )


def daily_summary(closes: DataFrame) -> DataFrame:
    """Closed trades, net result and win rate per calendar day."""
    known = closes.where(F.col("exit_time").isNotNull() & F.col("pnl").isNotNull())
    return known.groupBy(F.to_date("exit_time").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), _d(F.sum("pnl")).alias("net"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("win_rate")
    )


def streaks(trades: DataFrame, by: Sequence[str] = ("symbol",), rows: int | None = None) -> DataFrame:
    """Runs of consecutive wins or losses: each run's length, first and last row number.

    A run starts where the outcome differs from the previous row; the start position is carried forward.
    """
    by = list(by)
    flag = rolling(
        trades.withColumn("win", F.col("pnl") > 0),
        lambda df, w: df.withColumn("__new", F.coalesce(F.lag("win").over(w) != F.col("win"), F.lit(True))),
        back=1, by=by, rows=rows,
    )
    runs = running(flag, {"run_start": ("last", F.when(F.col("__new"), F.col("rn")))}, by, rows)
    return runs.groupBy(*by, "run_start", "win").agg(F.count(F.lit(1)).alias("length"), F.max("rn").alias("run_end"))


def perf_panel(closes: DataFrame, rows: int | None = None) -> DataFrame:
    """Largest win and loss, longest win and loss streaks, mean minutes of trades shorter than a week (numbered closes)."""
    minutes = (epoch_seconds("exit_time") - epoch_seconds("entry_time")) / 60.0
    timed = F.when((minutes > 0) & (minutes < 10080), minutes)
    totals = closes.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(_d(F.max(F.when(F.col("pnl") > 0, F.col("pnl")))), F.lit(0.0)).alias("largest_win"),
        F.coalesce(_d(F.min(F.when(F.col("pnl") <= 0, F.col("pnl")))), F.lit(0.0)).alias("largest_loss"),
        F.avg(timed).alias("avg_minutes"),
    )
    runs = streaks(closes, rows=rows).groupBy("symbol").agg(
        F.coalesce(F.max(F.when(F.col("win"), F.col("length"))), F.lit(0)).alias("best_streak"),
        F.coalesce(F.max(F.when(~F.col("win"), F.col("length"))), F.lit(0)).alias("worst_streak"),
    )
    return totals.join(runs, "symbol")


def event_regime_perf(journal: DataFrame) -> DataFrame:
    regime = (
        F.when(F.col("event") == "SCALE_OUT", "Scale-Out").when(F.col("event") == "MR_EXIT", "Ranging")
        .when(F.col("event") == "REVERSAL", "Trend Reversal").otherwise("Trend")
    )
    rows = journal.where(F.col("event").isin("CLOSE", "REVERSAL", "MR_EXIT", "SCALE_OUT"))
    return rows.groupBy(regime.alias("regime")).agg(
        F.count(F.lit(1)).alias("trades"), _d(F.sum("pnl")).alias("pnl"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("win_rate")
    )


def pnl_by(closes: DataFrame, key: Column) -> DataFrame:
    return closes.groupBy(key).agg(_d(F.sum("pnl")).alias("pnl"))


def rejection_matrix(stats: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(symbol, filter) counts pivoted to one row per symbol with the row total."""
    wide = stats.groupBy("symbol").pivot("filter", list(filters)).agg(F.sum("n"))
    cols = [F.coalesce(c, F.lit(0)).alias(c) for c in filters]
    wide = wide.select("symbol", *cols)
    return wide.withColumn("total_rejected", sum((F.col(c) for c in filters), F.lit(0)))


def melt_rejections(matrix: DataFrame, filters: Sequence[str]) -> DataFrame:
    return matrix.unpivot("symbol", list(filters), "filter", "n")


CLOSING = ("CLOSE", "SCALE_OUT", "CHANDELIER", "MR_NAKED_CLOSE", "MANUAL_CLOSE")


def ticket_r(journal: DataFrame, meta: DataFrame) -> DataFrame:
    """Outcome of every closed ticket: total pnl of its rows (0 where none has one) over the risk of
    its last opening row; raw pnl where the risk is unknown."""
    is_open = F.col("event") == "OPEN"
    last_open = F.max(F.when(is_open, F.struct("entry_time", "symbol", "volume", "entry_price", "sl")))
    t = journal.groupBy("ticket").agg(
        last_open.alias("o"), F.coalesce(F.sum("pnl"), F.lit(0)).alias("pnl"), F.bool_or(F.col("event").isin(*CLOSING)).alias("closed")
    ).where("closed")
    t = t.select("ticket", "pnl", F.col("o.symbol").alias("symbol"), F.col("o.entry_time").alias("entry_time"), "o")
    m = meta.select("symbol", "tick_size", "tick_value")
    sl_value = F.abs(F.col("o.entry_price") - F.col("o.sl")) / F.col("tick_size") * F.col("tick_value")
    usable = (F.col("o.volume") > 0) & (F.col("o.entry_price") > 0) & (F.col("o.sl") > 0) & (F.col("o.sl") != F.col("o.entry_price"))
    risk = F.when(usable & (F.col("tick_size") != 0) & (F.col("tick_value") != 0), F.col("o.volume") * sl_value)
    out = t.join(m, "symbol", "left").withColumn("risk", risk)
    return out.select("ticket", "symbol", "entry_time", _d("pnl").alias("pnl"), "risk", (_d("pnl") / F.col("risk")).alias("r"))


def recent_stats(outcomes: DataFrame, lookback: int, value: str = "r", order: Sequence[str] = ("entry_time", "ticket")) -> DataFrame:
    """Win rate, mean win and mean loss of each symbol's last `lookback` outcomes; needs ten outcomes."""
    from tidemark.operators.ranking import last_n

    known = outcomes.where(F.col(value).isNotNull()).select("symbol", *order, value)
    recent = last_n(known, ["symbol"], [F.desc(c) for c in order], lookback)
    count = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 10)
    v = F.col(value)
    agg = recent.groupBy("symbol").agg(
        (F.count_if(v > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.abs(F.avg(F.when(v < 0, v))), F.lit(0.0)).alias("avg_loss"),
    )
    return agg.join(count.select("symbol"), "symbol")


def kelly_mult(stats: DataFrame, fraction: float = 0.25, lo: float = 0.25, hi: float = 1.5, dd_col: str | None = None, dd_limit: float = 5.0) -> DataFrame:
    """Clamped fractional Kelly multiplier, halved in drawdown; `lo` where a side is missing."""
    b = F.col("avg_win") / F.col("avg_loss")
    raw = (F.col("win_rate") * b - (1 - F.col("win_rate"))) / b
    k = F.greatest(F.lit(lo), F.least(F.lit(hi), F.greatest(F.lit(0.0), raw) * fraction))
    k = F.when((F.col("avg_win") > 0) & (F.col("avg_loss") > 0), k).otherwise(F.lit(lo))
    if dd_col:
        k = F.when((F.col("avg_win") > 0) & (F.col("avg_loss") > 0) & (F.col(dd_col) >= dd_limit), k * 0.5).otherwise(k)
    return stats.withColumn("kelly_mult", k)


def execution_quality(fills: DataFrame) -> DataFrame:
    """Mean slippage percent, rejections and trades per symbol from (symbol, req_price, fill_price, rejected)."""
    ok = ~F.col("rejected")
    slip = F.when(ok & F.col("fill_price").isNotNull() & (F.col("req_price") > 0), F.abs(F.col("fill_price") - F.col("req_price")) / F.col("req_price") * 100)
    return fills.groupBy("symbol").agg(F.coalesce(F.avg(slip), F.lit(0.0)).alias("avg_slippage_pct"), F.count_if("rejected").alias("rejections"), F.count_if(ok).alias("trades"))


def open_risk(positions: DataFrame, meta: DataFrame, balance: float, cap_pct: float = 5.0) -> DataFrame:
    """Open risk over all positions as percent of the balance, against the cap."""
    risk = F.when(F.col("tick_size") > 0, F.abs(F.col("price_open") - F.col("sl")) / F.col("tick_size") * F.col("tick_value") * F.col("volume")).otherwise(0.0)
    total = positions.where(F.coalesce("sl", F.lit(0.0)) != 0).join(meta, "symbol").agg(F.coalesce(F.sum(risk), F.lit(0.0)).alias("total_risk"))
    pct = F.col("total_risk") / balance * 100
    return total.select("total_risk", pct.alias("open_risk_pct"), (pct > cap_pct).alias("block_entries"))


def daily_realized(deals: DataFrame) -> DataFrame:
    """Profit + commission + swap per trading day (UTC+5), balance operations (position 0) left out."""
    return deals.where(F.col("position_id") != 0).groupBy(trading_day("time").alias("day")).agg(F.sum(net_result()).alias("net"))


def net_result() -> Column:
    """Profit + commission + swap of a deal, missing ones counting as 0."""
    zero = F.lit(0).cast("decimal(18,4)")
    return F.coalesce("profit", zero) + F.coalesce("commission", zero) + F.coalesce("swap", zero)


def daily_loss_gate(deal_days: DataFrame, journal_days: DataFrame, balance: float, limit_pct: float = 5.0) -> DataFrame:
    """Worse of both realized results per day, its share of the balance and the halt flag."""
    j = journal_days.select("day", F.col("net").alias("__jnet"))
    worst = F.least(_d("net"), F.coalesce(_d("__jnet"), F.lit(0.0)))
    out = deal_days.join(j, "day", "left").select("day", worst.alias("realized"))
    pct = F.when(F.col("realized") < 0, -F.col("realized") / balance * 100).otherwise(0.0)
    return out.withColumn("loss_pct", pct).withColumn("halt", pct >= limit_pct)


def scenario_pnl(positions: DataFrame, shocks: DataFrame, meta: DataFrame, balance: float, breaker_pct: float = 15.0) -> DataFrame:
    """P&L per scenario with breaker flag, plus which scenario is the worst."""
    p = positions.join(meta, "symbol").join(shocks, "symbol")
    shocked = F.col("price_open") * (1 + F.col("shock_pct") / 100)
    pnl = pnl_currency(F.col("type"), F.col("price_open"), shocked, F.col("volume"), F.col("point"), F.col("tick_value"))
    out = p.groupBy("scenario").agg(F.round(F.sum(pnl), 2).alias("pnl"))
    out = out.withColumn("pnl_pct", F.round(F.col("pnl") / balance * 100, 2))
    worst = out.agg(F.min(F.struct("pnl_pct", "scenario"))["scenario"].alias("__worst"))
    return out.crossJoin(F.broadcast(worst)).select(
        "scenario", "pnl", "pnl_pct", F.when(F.abs("pnl_pct") < breaker_pct, "OK").otherwise("CIRCUIT BREAKER").alias("status"),
        (F.col("scenario") == F.col("__worst")).alias("is_worst"),
    )


def position_parts(deals: DataFrame, magic: int) -> DataFrame:
    """What a set of deals tells of each position: first and last deal, last deal of each side, net result, own or not.

    Parts of one position can be merged (``merged_parts``), so deals may come in any number of sets.
    """
    # The order of deals comes first in the struct, so the least and the greatest struct are the first and the last deal.
    deal = F.struct("time", "deal_no", "part_id", "venue", "price", "volume", "type", "symbol")
    net = F.col("profit") + F.coalesce(F.col("commission"), F.lit(0).cast("decimal(18,4)")) + F.coalesce(F.col("swap"), F.lit(0).cast("decimal(18,4)"))
    return deals.where(F.col("position_id") != 0).groupBy("position_id").agg(
        F.min(deal).alias("first"),
        F.max(deal).alias("last"),
        F.max(F.when(F.col("type") == 0, deal)).alias("last0"),
        F.max(F.when(F.col("type") == 1, deal)).alias("last1"),
        F.sum(net).alias("net"),
        F.bool_or(F.coalesce(F.col("magic") == magic, F.lit(False))).alias("own"),
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """One row per position out of several of ``position_parts`` over different deals."""
    latest = [F.max(c).alias(c) for c in ("last", "last0", "last1")]
    return parts.groupBy("position_id").agg(F.min("first").alias("first"), *latest, F.sum("net").alias("net"), F.bool_or("own").alias("own"))


def external_rows(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Journal rows of the foreign positions among ``position_parts``: one row per position."""
    g = parts.where(~F.col("own")).join(known.select(F.col("ticket").alias("position_id")), "position_id", "left_anti")
    opposite = F.when(F.col("first.type") == 0, F.col("last1")).otherwise(F.col("last0"))
    g = g.withColumn("out", F.coalesce(opposite, F.col("last")))
    side = F.when(F.col("first.type") == 0, 1.0).otherwise(-1.0)
    return g.select(
        F.col("position_id").alias("ticket"), F.col("first.symbol").alias("symbol"),
        F.when(F.col("first.type") == 0, "buy").otherwise("sell").alias("type"), F.col("first.volume").alias("volume"),
        F.col("first.price").alias("entry_price"), F.col("out.price").alias("exit_price"), F.col("out.time").alias("exit_time"),
        _d("net").alias("pnl"), ((F.col("out.price") - F.col("first.price")) * side).alias("pips"), F.lit("EXTERNAL").alias("event"),
    )


def external_trades(deals: DataFrame, known: DataFrame, magic: int) -> DataFrame:
    """Foreign positions as journal rows: first deal, last opposite deal (else last), net result, signed price move."""
    return external_rows(position_parts(deals, magic), known)


def position_pnl(positions: DataFrame, quotes: DataFrame, meta: DataFrame) -> DataFrame:
    """Floating result at the current quote; zero where the symbol has no usable point or tick value."""
    p = positions.join(quotes, "symbol").join(meta, "symbol")
    pnl = pnl_currency(F.col("type"), F.col("price_open"), F.col("price_current"), F.col("volume"), F.col("point"), F.col("tick_value"))
    return p.withColumn("floating_pnl", F.when((F.col("point") == 0) | (F.col("tick_value") == 0), 0.0).otherwise(pnl))


def gate_funnel(signals: DataFrame) -> DataFrame:
    """Signals, blocks per gate, passes and pass percent per symbol with a TOTAL row.

    Gates are the boolean columns htf_ok, exec_ok, score_ok in that order; a signal counts at its first failing gate.
    """
    htf, ex, sc = F.col("htf_ok"), F.col("exec_ok"), F.col("score_ok")
    g = signals.rollup("symbol").agg(
        F.count(F.lit(1)).alias("signal"), F.count_if(~htf).alias("htf"), F.count_if(htf & ~ex).alias("exec"),
        F.count_if(htf & ex & ~sc).alias("score"), F.count_if(htf & ex & sc).alias("passed"), F.grouping("symbol").alias("__all"),
    )
    return g.select(
        F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("symbol")).alias("symbol"), "signal", "htf", "exec", "score", "passed",
        (F.col("passed") / F.col("signal") * 100).alias("pass_pct"),
    )


def mode_summary(outcomes: DataFrame, rows: int | None = None) -> DataFrame:
    """Trades, win share, profit factor, net R and drawdown of cumulative R per mode (numbered per mode, column r)."""
    r = F.col("r")
    one = lambda c: F.when(c, 1).otherwise(0)
    also = {"trades": ("sum", F.lit(1)), "__wins": ("sum", one(r > 0)), "__gain": ("sum", F.when(r > 0, r)), "__loss": ("sum", F.when(r < 0, r))}
    g = folded(outcomes.select("mode", "rn", "r"), r, ["mode"], chunk_of(rows), ["rn"], also, from_start=False)
    loss = F.coalesce(F.abs("__loss"), F.lit(0.0))
    return g.select(
        "mode", "trades", (F.col("__wins") / F.col("trades")).alias("win_rate"), F.when(loss > 0, F.coalesce("__gain", F.lit(0.0)) / loss).otherwise(float("inf")).alias("pf"),
        F.col("total").alias("net_r"), F.col("fall").alias("max_dd"),
    )


def mr_cooldown(trades: DataFrame, cooldown_hours: int = 2, rows: int | None = None) -> DataFrame:
    """Whether a trade falls into the cooldown after at least two losses in a row right before it (numbered trades)."""
    by = ["symbol"]
    lost = F.col("pnl") < 0
    state = running(trades, {"__last_ok": ("last", F.when(~lost, F.col("rn")))}, by, rows)
    streak = F.when(lost, F.col("rn") - F.coalesce(F.col("__last_ok"), F.lit(0))).otherwise(0)
    marked = state.withColumn("loss_streak", streak)
    prev = rolling(
        marked,
        lambda df, w: df.withColumn("prev_streak", F.coalesce(F.lag("loss_streak").over(w), F.lit(0))).withColumn("prev_time", F.lag("time").over(w)),
        back=1, rows=rows,
    )
    close_by = F.col("time") < F.col("prev_time") + F.expr(f"INTERVAL {cooldown_hours} HOURS")
    return prev.withColumn("blocked", (F.col("prev_streak") >= 2) & F.coalesce(close_by, F.lit(False))).drop("__last_ok")
