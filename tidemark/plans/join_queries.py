"""Joins."""

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.source_queries import _ENTS, article_json
from tidemark.plans.views import KEYWORDS, Tables, sql
from tidemark.session import scratch_dir
from tidemark.sources.news import read_articles

ACTIVE_SQL = "SELECT o_orderkey AS ticket FROM orders WHERE o_orderstatus = 'O'"


def active_tickets(t: Tables):
    return t.read("orders").where(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("ticket"))


@query(
    "asof_htf_close",
    sql(
        "SELECT b.symbol, b.time, b.close, h.htf_close, h.available_at FROM bars b ASOF LEFT JOIN (SELECT symbol, available_at, close AS htf_close FROM bars_h4) h ON b.symbol = h.symbol AND b.time >= h.available_at"
    ),
)
def _(t: Tables):
    h4 = t.htf("4 hours").select("symbol", "available_at", F.col("close").alias("htf_close"))
    return J.asof_join(t.bars_h1().select("symbol", "time", "close"), h4, ["htf_close", "available_at"], right_on="available_at")


@query(
    "asof_ticks_to_minute_bars",
    sql("SELECT k.symbol, k.time, k.event_id, k.last, m.m1_close FROM ticks k ASOF LEFT JOIN (SELECT symbol, time + INTERVAL 1 MINUTE AS done, close AS m1_close FROM bars_m1) m ON k.symbol = m.symbol AND k.time >= m.done"),
)
def _(t: Tables):
    m1 = t.bars_m1().select("symbol", (F.col("time") + F.expr("INTERVAL 1 MINUTE")).alias("done"), F.col("close").alias("m1_close"))
    return J.asof_join(t.ticks().select("symbol", "time", "event_id", "last"), m1, ["m1_close"], right_on="done")


@query(
    "previous_day_close",
    sql("SELECT b.symbol, b.time, b.close, d.prev_close FROM bars b LEFT JOIN (SELECT symbol, time, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev_close FROM bars_d1) d ON d.symbol = b.symbol AND d.time = date_trunc('day', b.time)"),
)
def _(t: Tables):
    d1 = t.htf("1 day").select("symbol", "time", "rn", F.col("close").alias("prev_close"))
    return J.prev_period_join(t.bars_h1().select("symbol", "time", "close"), d1, ["prev_close"], "1 day")


@query(
    "positional_h4_close",
    sql("SELECT b.symbol, b.rn, b.close, h.h4_close FROM bars b LEFT JOIN (SELECT symbol, rn, close AS h4_close FROM bars_h4) h ON h.symbol = b.symbol AND h.rn - 1 = (b.rn - 1) // 4 - 1"),
)
def _(t: Tables):
    h4 = t.htf("4 hours").select("symbol", "rn", F.col("close").alias("h4_close"))
    return J.positional_htf(t.bars().select("symbol", "rn", "close"), h4, ["h4_close"], 4)


@query("intrabar_minutes", sql("SELECT m.symbol, m.time, h.time AS hour, m.close FROM bars_m1 m JOIN bars h ON m.symbol = h.symbol AND m.time >= h.time AND m.time < h.time + INTERVAL 1 HOUR"))
def _(t: Tables):
    return J.intrabar_join(t.bars_h1(), t.bars_m1()).select("symbol", "time", "hour", "close")


@query(
    "cross_asset_ratio",
    sql("SELECT b.symbol, b.time, b.close, r.close AS ref_close, round(coalesce(b.close / greatest(r.close, 1e-10), 1.0), 6) AS ratio FROM bars b LEFT JOIN bars r ON r.symbol = 'click' AND r.time = b.time"),
)
def _(t: Tables):
    return rounded(J.cross_asset_join(t.bars_h1().select("symbol", "time", "close"), "click"))


@query("symbol_pairs", sql("SELECT a.symbol AS s1, b.symbol AS s2, a.time, a.close AS x, b.close AS y FROM bars a JOIN bars b ON a.time = b.time AND a.symbol < b.symbol"))
def _(t: Tables):
    return J.symbol_pairs(t.bars_h1(), "close")


ENRICH_SQL = """SELECT j.ticket, j.event, j.exit_time, j.line, CAST(j.pnl AS DOUBLE) AS pnl, o.symbol, o.type, o.entry_price, o.entry_time
FROM journal j LEFT JOIN (SELECT * FROM journal WHERE event = 'OPEN') o ON o.ticket = j.ticket WHERE j.event <> 'OPEN'"""


# One reading of the journal: the OPEN row's fields by a window over the ticket.
@query(
    "enrich_closes",
    sql(
        """SELECT ticket, event, exit_time, line, CAST(pnl AS DOUBLE) AS pnl, o.symbol AS symbol, o.type AS type, o.entry_price AS entry_price, o.entry_time AS entry_time
FROM (SELECT ticket, event, exit_time, line, pnl, min({'entry_time': entry_time, 'symbol': symbol, 'type': type, 'entry_price': entry_price}) FILTER (event = 'OPEN') OVER (PARTITION BY ticket) AS o FROM journal) WHERE event <> 'OPEN'"""
    ),
)
def _(t: Tables):
    out = J.enrich_closes(t.journal())
    return out.select("ticket", "event", "exit_time", "line", F.col("pnl").cast("double").alias("pnl"), "symbol", "type", "entry_price", "entry_time")


_ORPHANS = "SELECT * FROM journal WHERE event = 'OPEN' AND ticket NOT IN (SELECT ticket FROM active) AND ticket NOT IN (SELECT ticket FROM journal WHERE event <> 'OPEN')"


@query("orphan_opens", sql("SELECT ticket, symbol, type, entry_price FROM orphans", active=ACTIVE_SQL, orphans=_ORPHANS))
def _(t: Tables):
    return J.orphan_opens(t.journal(), active_tickets(t)).select("ticket", "symbol", "type", "entry_price")


@query(
    "resolve_orphans",
    sql(
        """SELECT o.ticket, coalesce(d.price, 0.0::DOUBLE) AS exit_price, TIMESTAMP '2002-01-01 00:00:00' AS exit_time, CAST(coalesce(d.profit, 0) AS DOUBLE) AS pnl,
round(CASE WHEN d.price IS NULL THEN 0.0 ELSE (d.price - o.entry_price) * CASE WHEN o.type = 'buy' THEN 1 ELSE -1 END END, 4) AS pips, 'MANUAL_CLOSE' AS event
FROM orphans o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY time DESC, deal_no DESC, part_id DESC, venue DESC, price DESC, volume DESC, profit DESC) AS k
  FROM deals) WHERE k = 1) d ON d.position_id = o.ticket""",
        active=ACTIVE_SQL,
        orphans="SELECT * FROM journal WHERE event = 'OPEN' AND ticket NOT IN (SELECT ticket FROM active) AND ticket NOT IN (SELECT ticket FROM journal WHERE event = 'CLOSE')",
    ),
)
def _(t: Tables):
    # Only plain CLOSE rows count as resolved here, so that many orphans have deals.
    j = t.journal().where(F.col("event").isin("OPEN", "CLOSE"))
    out = J.resolve_orphans(j, active_tickets(t), t.deals(), "2002-01-01 00:00:00")
    return out.select("ticket", "exit_price", "exit_time", F.col("pnl").cast("double").alias("pnl"), F.round("pips", 4).alias("pips"), "event")


@query(
    "external_positions",
    sql("SELECT position_id, count(*) AS n_deals FROM deals WHERE position_id <> 0 AND position_id NOT IN (SELECT ticket FROM active) GROUP BY 1 HAVING NOT bool_or(magic = 20240)", active=ACTIVE_SQL),
)
def _(t: Tables):
    return J.external_positions(t.deals(), active_tickets(t), 20240)


@query(
    "param_grid_by_symbol",
    sql("SELECT symbol, ema_fast, ema_slow, sl, rr FROM (SELECT DISTINCT symbol FROM trades), (VALUES (8), (10), (12)) a(ema_fast), (VALUES (32), (40)) b(ema_slow), (VALUES (1.0::DOUBLE), (1.5::DOUBLE)) c(sl), (VALUES (2.0::DOUBLE), (2.5::DOUBLE)) d(rr)"),
)
def _(t: Tables):
    grid = J.param_grid(t.spark, {"ema_fast": [8, 10, 12], "ema_slow": [32, 40], "sl": [1.0, 1.5], "rr": [2.0, 2.5]})
    axes = F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in grid.columns[:-1]]) for r in grid.collect()]))
    return t.trades().select("symbol").distinct().select("symbol", axes.alias("g")).select("symbol", "g.*")


SHOCKS = [("crash", "click", -10.0), ("crash", "view", -8.0), ("crash", "purchase", -12.0), ("rally", "click", 5.0), ("rally", "signup", 7.0), ("mixed", "error", -3.0), ("mixed", "view", 4.0)]
SHOCKS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}',{c}::DOUBLE)" for a, b, c in SHOCKS) + ") t(scenario, symbol, shock_pct)"


def shocks(t: Tables):
    return t.spark.createDataFrame(SHOCKS, "scenario string, symbol string, shock_pct double")


@query("scenario_positions", sql("SELECT s.scenario, p.symbol, p.day_no, p.price_open, s.shock_pct FROM positions p JOIN shocks s ON s.symbol = p.symbol", shocks=SHOCKS_SQL))
def _(t: Tables):
    return J.scenario_join(t.positions(), shocks(t)).select("scenario", "symbol", "day_no", "price_open", "shock_pct")


# One constant pattern per keyword, so the checking engine compiles each only once.
KW_SQL = " UNION ".join(
    rf"SELECT DISTINCT article_id, '{s}' AS symbol FROM articles WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){k}($|[^\p{{L}}\p{{N}}_])')"
    for k, s in KEYWORDS
)


@query("match_keywords", sql(KW_SQL))
def _(t: Tables):
    return J.match_keywords(t.articles(), t.keywords())


CODES = [("EN_IDX", "EN"), ("FR_IDX", "FR"), ("EST_IDX", "EST")]


@query(
    "match_entities",
    sql(
        """SELECT article_id, symbol, round(score, 6) AS score FROM (
SELECT * FROM direct UNION ALL SELECT DISTINCT 'a' || a.article_id, c.symbol, a.score FROM articles a JOIN codes c ON (contains(lower(a.text || ' '), lower(c.code)) OR (a.source <> '' AND contains(lower(a.text || ' '), lower(a.source))))
WHERE a.score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.article_id = 'a' || a.article_id AND d.symbol = c.symbol))""",
        ents=_ENTS,
        codes="SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in CODES) + ") t(symbol, code)",
        direct="SELECT article_id, symbol, avg(score) AS score FROM ents JOIN codes ON entity = code OR ends_with(entity, code) GROUP BY 1, 2",
    ),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "articles")
    article_json(t, path)
    return rounded(J.match_entities(read_articles(t.spark, path), t.spark.createDataFrame(CODES, "symbol string, code string")))


@query("word_match", sql(r"SELECT article_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AS has_word FROM articles"))
def _(t: Tables):
    return t.articles().select("article_id", J.word_match(F.col("text"), F.lit("the")).alias("has_word"))


@query(
    "bars_since_entry",
    sql("SELECT p.symbol, p.day_no, b.time AS bar_time, b.high, b.low, b.close FROM positions p JOIN bars b ON b.symbol = p.symbol AND b.time >= coalesce((SELECT max(x.time) FROM bars x WHERE x.symbol = p.symbol AND x.time < p.time), p.time)"),
)
def _(t: Tables):
    return J.bars_since_entry(t.positions(), t.bars_h1()).select("symbol", "day_no", "bar_time", "high", "low", "close")
