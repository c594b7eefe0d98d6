"""Trade, journal and portfolio aggregation."""

from pyspark.sql import functions as F

from tidemark.functions.times import trading_day, week_start
from tidemark.operators import trades as X
from tidemark.operators.chunks import index_rows
from tidemark.operators.joins import enrich_closes
from tidemark.plans.flow_queries import rounded
from tidemark.plans.join_queries import ACTIVE_SQL, ENRICH_SQL, SHOCKS_SQL, active_tickets, shocks
from tidemark.plans.registry import query
from tidemark.plans.views import ORDER_BLOCK, Tables, sql
from tidemark.session import settle

BASE = 1000000.0
OUT = """count(*) AS n_trades, CAST(sum(pnl) AS DOUBLE) AS total, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate,
  round(coalesce(CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / count(*) FILTER (pnl > 0), 0), 6) AS avg_win,
  round(coalesce(abs(CAST(sum(pnl) FILTER (pnl <= 0) AS DOUBLE)) / count(*) FILTER (pnl <= 0), 0), 6) AS avg_loss,
  round(CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / CAST(abs(sum(pnl) FILTER (pnl < 0)) AS DOUBLE), 6) AS profit_factor,
  CAST(max(dd) AS DOUBLE) AS max_dd"""


def _curve(base: float) -> dict[str, str]:
    return {
        "eq": f"SELECT *, {base:.0f} + sum(pnl) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS equity FROM numbered",
        "curve": f"SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), {base:.0f}) AS peak FROM eq",
    }


@query(
    "equity_curve",
    sql(
        "SELECT symbol, rn, CAST(pnl AS DOUBLE) AS pnl, CAST(equity AS DOUBLE) AS equity, CAST(peak AS DOUBLE) AS peak, round(CAST(peak - equity AS DOUBLE) / CAST(peak AS DOUBLE) * 100, 6) AS drawdown_pct FROM curve",
        **_curve(BASE),
    ),
)
def _(t: Tables):
    d = lambda c: F.col(c).cast("double").alias(c)
    return rounded(X.equity_curve(t.numbered_trades(), BASE).select("symbol", "rn", d("pnl"), d("equity"), d("peak"), "drawdown_pct"))


@query(
    "trade_metrics",
    sql(
        """SELECT m.*, round(CASE WHEN sd > 0 THEN mn / sd * sqrt(252) ELSE 0 END, 6) AS sharpe, round(CASE WHEN max_dd > 0 THEN abs(total / max_dd) ELSE 0 END, 6) AS calmar
FROM met m JOIN sh USING (symbol)""".replace("m.*", "symbol, n_trades, total, win_rate, avg_win, avg_loss, profit_factor, max_dd"),
        **_curve(BASE),
        met=f"SELECT symbol, {OUT} FROM (SELECT *, peak - equity AS dd FROM curve) GROUP BY symbol",
        sh="""SELECT symbol, avg(d) AS mn, stddev_pop(d) AS sd FROM (SELECT symbol, CAST(equity - lag(equity) OVER (PARTITION BY symbol ORDER BY rn) AS DOUBLE) AS d
  FROM curve WHERE (rn - 1) % 6 = 0) GROUP BY symbol""",
    ),
)
def _(t: Tables):
    return rounded(X.trade_metrics(t.numbered_trades(), BASE))


@query(
    "trade_metrics_h1",
    sql(
        """SELECT symbol, n_trades, total, win_rate, avg_win, avg_loss, profit_factor, max_dd, round(total / ((n_trades + 1) / 8766.0::DOUBLE) / sd * sqrt(8766.0::DOUBLE), 6) AS sharpe,
round(CASE WHEN max_dd > 0 THEN abs(total / max_dd) ELSE 0 END, 6) AS calmar FROM (SELECT symbol, """
        + OUT
        + ", stddev_pop(CAST(pnl AS DOUBLE)) AS sd FROM (SELECT *, peak - equity AS dd FROM curve) GROUP BY symbol)",
        **_curve(0),
    ),
)
def _(t: Tables):
    return rounded(X.trade_metrics_h1(t.numbered_trades()))


@query("by_regime", sql("SELECT regime, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, CAST(sum(pnl) AS DOUBLE) AS pnl FROM trades GROUP BY 1"))
def _(t: Tables):
    return X.by_regime(t.trades())


@query("by_exit_reason", sql("SELECT exit_reason, count(*) AS n FROM trades GROUP BY 1"))
def _(t: Tables):
    return X.by_exit_reason(t.trades())


@query(
    "weekly_summary",
    sql(
        """SELECT coalesce(symbol, 'ALL') AS symbol, count(*) AS trades, CAST(sum(pnl) AS DOUBLE) AS total_pnl, round(count(*) FILTER (pnl > 0) / count(*) * 100, 6) AS wr,
  round(coalesce(gw / nullif(gl, 0), 0), 6) AS pf, round(coalesce(gw / nullif(nw, 0), 0), 6) AS avg_win, round(coalesce(gl / nullif(count(*) - nw, 0), 0), 6) AS avg_loss,
  max(best).ticket AS best_ticket, CAST(max(best).pnl AS DOUBLE) AS best_pnl, min(best).ticket AS worst_ticket, CAST(min(best).pnl AS DOUBLE) AS worst_pnl
FROM wk GROUP BY ROLLUP(symbol)""".replace("gw / nullif(gl, 0)", "CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / nullif(abs(CAST(sum(pnl) FILTER (pnl <= 0) AS DOUBLE)), 0)")
        .replace("gw / nullif(nw, 0)", "CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / nullif(count(*) FILTER (pnl > 0), 0)")
        .replace("gl / nullif(count(*) - nw, 0)", "abs(CAST(sum(pnl) FILTER (pnl <= 0) AS DOUBLE)) / nullif(count(*) FILTER (pnl <= 0), 0)"),
        enriched=ENRICH_SQL.replace("j.line,", "j.line, j.pnl AS dpnl,"),
        wk="SELECT symbol, dpnl AS pnl, {'pnl': dpnl, 'ticket': ticket, 'line': line} AS best FROM enriched WHERE event IN ('CLOSE','REVERSAL','MR_EXIT') AND exit_time >= TIMESTAMP '2001-03-05 00:00:00'",
    ),
)
def _(t: Tables):
    closes = enrich_closes(t.journal()).where(F.col("event").isin("CLOSE", "REVERSAL", "MR_EXIT"))
    return rounded(X.weekly_summary(closes, "2001-03-08 12:00:00"))


@query(
    "daily_summary",
    sql("SELECT CAST(exit_time AS DATE) AS day, count(*) AS trades, CAST(sum(pnl) AS DOUBLE) AS net, round(count(*) FILTER (pnl > 0) / count(*) * 100, 6) AS win_rate FROM closed GROUP BY 1"),
)
def _(t: Tables):
    return rounded(X.daily_summary(t.closed()))


STREAK_SQL = {
    "flags": "SELECT *, pnl > 0 AS win, CASE WHEN (pnl > 0) IS DISTINCT FROM lag(pnl > 0) OVER (PARTITION BY symbol ORDER BY rn) THEN rn END AS s FROM numbered",
    "runs": "SELECT symbol, run_start, win, count(*) AS length, max(rn) AS run_end FROM (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run_start FROM flags) GROUP BY 1, 2, 3",
}


@query("win_loss_streaks", sql("SELECT * FROM runs", **STREAK_SQL))
def _(t: Tables):
    return X.streaks(t.numbered_trades())


def numbered_closes(t: Tables):
    """Enriched closes numbered per symbol in exit order."""
    closes = enrich_closes(t.journal()).where(F.col("event").isin("CLOSE", "REVERSAL", "MR_EXIT") & F.col("symbol").isNotNull())
    buckets = [F.to_date("exit_time"), F.floor(F.col("ticket") / ORDER_BLOCK)]
    return settle(index_rows(closes, ["symbol"], buckets, ["exit_time", "ticket", "line", "pnl"]))


CLOSES_SQL = {
    "enriched": ENRICH_SQL.replace("j.line,", "j.line, j.pnl AS dpnl,"),
    "nclosed": """SELECT * REPLACE (dpnl AS pnl), row_number() OVER (PARTITION BY symbol ORDER BY exit_time, ticket, line, dpnl) AS rn
  FROM enriched WHERE event IN ('CLOSE','REVERSAL','MR_EXIT') AND symbol IS NOT NULL""",
}


@query(
    "perf_panel",
    sql(
        """SELECT symbol, trades, largest_win, largest_loss, avg_minutes, best_streak, worst_streak FROM (SELECT symbol, count(*) AS trades, CAST(coalesce(max(pnl) FILTER (pnl > 0), 0) AS DOUBLE) AS largest_win,
CAST(coalesce(min(pnl) FILTER (pnl <= 0), 0) AS DOUBLE) AS largest_loss, round(avg(mins) FILTER (mins > 0 AND mins < 10080), 6) AS avg_minutes
FROM (SELECT *, (epoch(exit_time) - epoch(entry_time)) / 60.0 AS mins FROM nclosed) GROUP BY 1) JOIN
(SELECT symbol, coalesce(max(length) FILTER (win), 0) AS best_streak, coalesce(max(length) FILTER (NOT win), 0) AS worst_streak FROM runs GROUP BY 1) USING (symbol)""",
        **CLOSES_SQL,
        flags=STREAK_SQL["flags"].replace("numbered", "nclosed"),
        runs=STREAK_SQL["runs"],
    ),
)
def _(t: Tables):
    return rounded(X.perf_panel(numbered_closes(t)))


@query(
    "event_regime_perf",
    sql("""SELECT CASE event WHEN 'SCALE_OUT' THEN 'Scale-Out' WHEN 'MR_EXIT' THEN 'Ranging' WHEN 'REVERSAL' THEN 'Trend Reversal' ELSE 'Trend' END AS regime, count(*) AS trades,
CAST(sum(pnl) AS DOUBLE) AS pnl, round(count(*) FILTER (pnl > 0) / count(*) * 100, 6) AS win_rate FROM journal WHERE event IN ('CLOSE','REVERSAL','MR_EXIT','SCALE_OUT') GROUP BY 1"""),
)
def _(t: Tables):
    return rounded(X.event_regime_perf(t.journal()))


@query("pnl_by_day", sql("SELECT CAST(exit_time AS DATE) AS day, CAST(sum(pnl) AS DOUBLE) AS pnl FROM closed GROUP BY 1"))
def _(t: Tables):
    return X.pnl_by(t.closed(), F.to_date("exit_time").alias("day"))


@query("pnl_by_symbol", sql("SELECT symbol, CAST(sum(dpnl) AS DOUBLE) AS pnl FROM enriched WHERE event IN ('CLOSE','REVERSAL','MR_EXIT') GROUP BY 1", enriched=CLOSES_SQL["enriched"]))
def _(t: Tables):
    return X.pnl_by(enrich_closes(t.journal()).where(F.col("event").isin("CLOSE", "REVERSAL", "MR_EXIT")), F.col("symbol"))


FILTERS = ["sanity", "ml_gate", "tail_risk"]
_REJ = """SELECT symbol, CASE WHEN regime = 'A' THEN 'sanity' WHEN regime = 'N' THEN 'ml_gate' ELSE 'tail_risk' END AS filter, count(*) AS n FROM trades WHERE pnl < 0 GROUP BY 1, 2"""


def rejections(t: Tables):
    f = F.when(F.col("regime") == "A", "sanity").when(F.col("regime") == "N", "ml_gate").otherwise("tail_risk")
    return t.trades().where(F.col("pnl") < 0).groupBy("symbol", f.alias("filter")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rejection_matrix",
    sql(
        "SELECT symbol, CAST(coalesce(sum(n) FILTER (filter = 'sanity'), 0) AS BIGINT) AS sanity, CAST(coalesce(sum(n) FILTER (filter = 'ml_gate'), 0) AS BIGINT) AS ml_gate, CAST(coalesce(sum(n) FILTER (filter = 'tail_risk'), 0) AS BIGINT) AS tail_risk, CAST(sum(n) AS BIGINT) AS total_rejected FROM rej GROUP BY 1",
        rej=_REJ,
    ),
)
def _(t: Tables):
    return X.rejection_matrix(rejections(t), FILTERS)


@query("rejection_melt", sql("SELECT s.symbol, f.filter, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT symbol FROM rej) s CROSS JOIN (VALUES ('sanity'), ('ml_gate'), ('tail_risk')) f(filter) LEFT JOIN rej r ON r.symbol = s.symbol AND r.filter = f.filter", rej=_REJ))
def _(t: Tables):
    return X.melt_rejections(X.rejection_matrix(rejections(t), FILTERS), FILTERS)


_META5 = "SELECT DISTINCT substr(o_orderpriority, 1, 1) AS symbol, 0.01::DOUBLE AS tick_size, 1.0::DOUBLE AS tick_value FROM orders WHERE o_orderpriority <> '5-LOW'"


def priority_meta(t: Tables):
    """Symbol metadata of the journal's symbols; one symbol has none."""
    p = t.read("orders").where(F.col("o_orderpriority") != "5-LOW").select(F.substring("o_orderpriority", 1, 1).alias("symbol")).distinct()
    return p.select("symbol", F.lit(0.01).alias("tick_size"), F.lit(1.0).alias("tick_value"))


TICKET_R = {
    "meta5": _META5,
    "tr": """SELECT o.ticket, o.symbol, o.entry_time, CAST(c.pnl AS DOUBLE) AS pnl, o.volume * (abs(o.entry_price - o.sl) / m.tick_size * m.tick_value) AS risk
  FROM (SELECT ticket, sum(pnl) AS pnl, bool_or(event IN ('CLOSE','SCALE_OUT','CHANDELIER','MR_NAKED_CLOSE','MANUAL_CLOSE')) AS closed FROM journal GROUP BY 1) c
  LEFT JOIN (SELECT * FROM journal WHERE event = 'OPEN') o ON o.ticket = c.ticket LEFT JOIN meta5 m ON m.symbol = o.symbol WHERE c.closed""",
}


@query("ticket_r", sql("SELECT ticket, symbol, entry_time, pnl, round(risk, 6) AS risk, round(pnl / risk, 6) AS r FROM tr", **TICKET_R))
def _(t: Tables):
    return rounded(X.ticket_r(t.journal(), priority_meta(t)))


RECENT = {
    **TICKET_R,
    "recent": """SELECT symbol, win_rate, avg_win, avg_loss FROM (SELECT symbol, count(*) FILTER (r > 0) / count(*) AS win_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win,
  coalesce(abs(avg(r) FILTER (r < 0)), 0) AS avg_loss, max(n) AS n FROM (SELECT symbol, pnl / risk AS r, count(*) OVER (PARTITION BY symbol) AS n,
  row_number() OVER (PARTITION BY symbol ORDER BY entry_time DESC, ticket DESC) AS k FROM tr WHERE risk IS NOT NULL) WHERE k <= 50 GROUP BY symbol) WHERE n >= 10""",
}


@query("recent_trade_stats", sql("SELECT symbol, round(win_rate, 6) AS win_rate, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss FROM recent", **RECENT))
def _(t: Tables):
    return rounded(X.recent_stats(X.ticket_r(t.journal(), priority_meta(t)), 50))


@query(
    "kelly_mult",
    sql(
        """SELECT symbol, round(CASE WHEN avg_win > 0 AND avg_loss > 0 THEN greatest(0.25, least(1.5, greatest(0, (win_rate * (avg_win / avg_loss) - (1 - win_rate)) / (avg_win / avg_loss)) * 0.25))
* CASE WHEN symbol IN ('1', '2') THEN 0.5 ELSE 1 END ELSE 0.25 END, 6) AS kelly_mult FROM recent""",
        **RECENT,
    ),
)
def _(t: Tables):
    stats = X.recent_stats(X.ticket_r(t.journal(), priority_meta(t)), 50)
    stats = stats.withColumn("dd_pct", F.when(F.col("symbol").isin("1", "2"), 6.0).otherwise(1.0))
    return rounded(X.kelly_mult(stats, dd_col="dd_pct").select("symbol", "kelly_mult"))


@query(
    "execution_quality",
    sql("SELECT event_type AS symbol, round(coalesce(avg(abs(value * 1.0001 - value) / value * 100) FILTER (user_id <> 7 AND value > 0), 0), 6) AS avg_slippage_pct, count(*) FILTER (user_id = 7) AS rejections, count(*) FILTER (user_id <> 7) AS trades FROM events GROUP BY 1"),
)
def _(t: Tables):
    f = t.read("events").select(F.col("event_type").alias("symbol"), F.col("value").alias("req_price"), (F.col("value") * 1.0001).alias("fill_price"), (F.col("user_id") == 7).alias("rejected"))
    return rounded(X.execution_quality(f))


@query("open_risk", sql("SELECT round(r, 4) AS total_risk, round(r / 1000000 * 100, 6) AS open_risk_pct, r / 1000000 * 100 > 5 AS block_entries FROM (SELECT sum(abs(price_open - sl) / tick_size * tick_value * volume) AS r FROM positions JOIN event_meta USING (symbol))"))
def _(t: Tables):
    out = X.open_risk(t.positions(), t.event_meta(), BASE)
    return out.select(F.round("total_risk", 4).alias("total_risk"), F.round("open_risk_pct", 6).alias("open_risk_pct"), "block_entries")


_REAL = "SELECT CAST(time + INTERVAL 5 HOURS AS DATE) AS day, sum(profit + commission + swap) AS net FROM deals WHERE position_id <> 0 GROUP BY 1"


@query("daily_realized", sql("SELECT day, CAST(net AS DOUBLE) AS net FROM real", real=_REAL))
def _(t: Tables):
    return X.daily_realized(t.deals()).select("day", F.col("net").cast("double").alias("net"))


@query(
    "daily_loss_gate",
    sql(
        "SELECT day, realized, round(CASE WHEN realized < 0 THEN -realized / 1000000 * 100 ELSE 0 END, 6) AS loss_pct, CASE WHEN realized < 0 THEN -realized / 1000000 * 100 ELSE 0 END >= 5 AS halt FROM (SELECT r.day, least(CAST(r.net AS DOUBLE), coalesce(CAST(j.net AS DOUBLE), 0)) AS realized FROM real r LEFT JOIN jr j USING (day))",
        real=_REAL,
        jr="SELECT CAST(exit_time + INTERVAL 5 HOURS AS DATE) AS day, sum(pnl) AS net FROM closed GROUP BY 1",
    ),
)
def _(t: Tables):
    j = t.closed().groupBy(trading_day("exit_time").alias("day")).agg(F.sum("pnl").alias("net"))
    return rounded(X.daily_loss_gate(X.daily_realized(t.deals()), j, BASE))


@query(
    "scenario_pnl",
    sql(
        """SELECT scenario, pnl, pnl_pct, CASE WHEN abs(pnl_pct) < 15 THEN 'OK' ELSE 'CIRCUIT BREAKER' END AS status, scenario = (SELECT scenario FROM sc ORDER BY pnl_pct, scenario LIMIT 1) AS is_worst FROM sc""",
        shocks=SHOCKS_SQL,
        sc="""SELECT scenario, round(sum(CASE WHEN type = 'buy' THEN 1 ELSE -1 END * (price_open * (1 + shock_pct / 100) - price_open) / point * tick_value * volume), 2) AS pnl,
  round(round(sum(CASE WHEN type = 'buy' THEN 1 ELSE -1 END * (price_open * (1 + shock_pct / 100) - price_open) / point * tick_value * volume), 2) / 100000 * 100, 2) AS pnl_pct
  FROM positions JOIN event_meta USING (symbol) JOIN shocks USING (symbol) GROUP BY scenario""",
    ),
)
def _(t: Tables):
    return X.scenario_pnl(t.positions(), shocks(t), t.event_meta(), 100000.0)


@query(
    "external_trades",
    sql(
        """SELECT f.position_id AS ticket, f.symbol, CASE WHEN f.type = 0 THEN 'buy' ELSE 'sell' END AS type, f.volume, f.price AS entry_price, coalesce(o.price, l.price) AS exit_price,
coalesce(o.time, l.time) AS exit_time, CAST(n.net AS DOUBLE) AS pnl, round((coalesce(o.price, l.price) - f.price) * CASE WHEN f.type = 0 THEN 1 ELSE -1 END, 6) AS pips, 'EXTERNAL' AS event
FROM (SELECT * FROM dr WHERE k = 1) f JOIN (SELECT * FROM dr WHERE kd = 1) l USING (position_id)
LEFT JOIN (SELECT position_id, type, price, time, row_number() OVER (PARTITION BY position_id, type ORDER BY kd) AS q FROM dr) o ON o.position_id = f.position_id AND o.type = 1 - f.type AND o.q = 1
JOIN (SELECT position_id, sum(profit + commission + swap) AS net FROM deals GROUP BY 1 HAVING NOT bool_or(magic = 20240)) n ON n.position_id = f.position_id WHERE f.position_id <> 0 AND f.position_id NOT IN (SELECT ticket FROM active)""",
        active=ACTIVE_SQL,
        dr="SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY time, deal_no, part_id, venue, price, volume) AS k, row_number() OVER (PARTITION BY position_id ORDER BY time DESC, deal_no DESC, part_id DESC, venue DESC, price DESC, volume DESC) AS kd FROM deals",
    ),
)
def _(t: Tables):
    return rounded(X.external_trades(t.deals(), active_tickets(t), 20240))


QUOTES_SQL = "SELECT symbol, last(close ORDER BY time) AS price_current FROM bars GROUP BY symbol"


def quotes(t: Tables):
    return t.bars_h1().groupBy("symbol").agg(F.max_by("close", "time").alias("price_current"))


@query("position_pnl", sql("SELECT p.symbol, day_no, round(CASE WHEN type = 'buy' THEN price_current - price_open ELSE price_open - price_current END / 0.01::DOUBLE * 1.0 * volume, 4) AS floating_pnl FROM positions p JOIN q USING (symbol)", q=QUOTES_SQL))
def _(t: Tables):
    return X.position_pnl(t.positions(), quotes(t), t.event_meta()).select("symbol", "day_no", F.round("floating_pnl", 4).alias("floating_pnl"))


@query(
    "gate_funnel",
    sql("""SELECT coalesce(symbol, 'TOTAL') AS symbol, count(*) AS signal, count(*) FILTER (NOT h) AS htf, count(*) FILTER (h AND NOT e) AS exec, count(*) FILTER (h AND e AND NOT s) AS score,
count(*) FILTER (h AND e AND s) AS passed, round(count(*) FILTER (h AND e AND s) / count(*) * 100, 6) AS pass_pct FROM (SELECT symbol, regime <> 'R' AS h, volume > 10 AS e, pnl > 0 AS s FROM trades) GROUP BY ROLLUP(symbol)"""),
)
def _(t: Tables):
    s = t.trades().select("symbol", (F.col("regime") != "R").alias("htf_ok"), (F.col("volume") > 10).alias("exec_ok"), (F.col("pnl") > 0).alias("score_ok"))
    return rounded(X.gate_funnel(s))


@query(
    "mode_summary",
    sql(
        """SELECT mode, count(*) AS trades, round(count(*) FILTER (r > 0) / count(*), 6) AS win_rate, round(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)), 6) AS pf, sum(r) AS net_r, max(pk - cr) AS max_dd
FROM (SELECT *, max(cr) OVER (PARTITION BY mode ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, sum(r) OVER (PARTITION BY mode ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cr
FROM (SELECT regime AS mode, CASE WHEN pnl > 0 THEN 2.0::DOUBLE WHEN pnl < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS r, row_number() OVER (PARTITION BY regime ORDER BY time, ticket, line, part_id, venue, volume, price, pnl) AS rn FROM trades))) GROUP BY mode"""
    ),
)
def _(t: Tables):
    r = F.when(F.col("pnl") > 0, 2.0).when(F.col("pnl") < 0, -1.0).otherwise(0.0)
    n = t.numbered_trades(by=("regime",)).select(F.col("regime").alias("mode"), r.alias("r"), "rn")
    return rounded(X.mode_summary(n))


@query(
    "mr_cooldown",
    sql(
        """SELECT symbol, rn, ls AS loss_streak, coalesce(lag(ls) OVER w, 0) AS prev_streak, coalesce(lag(ls) OVER w, 0) >= 2 AND coalesce(time < lag(time) OVER w + INTERVAL 48 HOURS, false) AS blocked
FROM (SELECT *, CASE WHEN pnl < 0 THEN rn - coalesce(max(CASE WHEN pnl >= 0 THEN rn END) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS ls FROM numbered)
WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""
    ),
)
def _(t: Tables):
    return X.mr_cooldown(t.numbered_trades(), 48).select("symbol", "rn", "loss_streak", "prev_streak", "blocked")
