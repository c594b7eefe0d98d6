"""Sources and sinks: every query writes derived data to a scratch folder and reads it back."""

from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, sql
from tidemark.session import scratch_dir
from tidemark.sources import bars as B
from tidemark.sources import journal as J
from tidemark.sources import news as N
from tidemark.sources import reports as P


@query(
    "read_bar_csv",
    sql(
        """SELECT symbol, timeframe, time, open, high, low, close, tick_volume, round(spread, 6) AS spread FROM (
SELECT 'H1' AS timeframe, symbol, time, open, high, low, close, tick_volume, spread FROM bars
UNION ALL SELECT 'M1', symbol, time, open, high, low, close, tick_volume, 0.0 FROM bars_m1)"""
    ),
)
def _(t: Tables):
    epoch, iso = scratch_dir(t.spark, "epoch"), scratch_dir(t.spark, "iso")
    B.write_bars(t.bars_h1(), epoch)
    m1 = t.bars_m1().drop("spread").withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"))
    m1.write.partitionBy("symbol").option("header", True).csv(iso)
    return rounded(B.union_all([B.read_bars(t.spark, epoch), B.read_bars(t.spark, iso, timeframe="M1")]))


@query("merge_history_pages", sql("SELECT symbol, time, open, high, low, close, tick_volume FROM bars WHERE time >= TIMESTAMP '2024-01-05 00:00:00'"))
def _(t: Tables):
    bars = t.bars_h1().drop("spread")
    early = bars.where(F.col("time") < F.lit("2024-01-20").cast("timestamp_ntz"))
    late = bars.where(F.col("time") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return B.merge_pages([early, late], "2024-01-05 00:00:00")


@query("dedupe_bars", sql("SELECT symbol, time, open, high, low, close, tick_volume FROM bars"))
def _(t: Tables):
    bars = t.bars_h1().drop("spread")
    return B.dedupe_bars(bars.unionByName(bars.where(F.hour("time") < 12)))


@query(
    "read_journal_quarantine",
    sql(
        """SELECT part, event, count(*) AS n, CAST(sum(pnl) AS DOUBLE) AS pnl FROM (
SELECT CASE WHEN event = 'MANUAL_CLOSE' THEN 'bad' ELSE 'good' END AS part, CASE WHEN event = 'MANUAL_CLOSE' THEN NULL ELSE event END AS event,
CASE WHEN event = 'MANUAL_CLOSE' THEN NULL ELSE pnl END AS pnl FROM journal) GROUP BY 1, 2"""
    ),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "journal")
    j = t.journal()
    blank = F.lit("")
    cells = {c: F.coalesce(F.col(c).cast("string"), blank) if c in j.columns else blank for c in J.JOURNAL_COLUMNS}
    line = F.concat_ws(",", *cells.values())
    torn = F.concat_ws(",", *list(cells.values())[:9])  # a row cut off while it was being appended
    j.select(F.when(F.col("event") == "MANUAL_CLOSE", torn).otherwise(line).alias("value")).write.text(path)
    good, bad = J.read_journal(t.spark, path)
    rows = good.select(F.lit("good").alias("part"), "event", "pnl").unionByName(
        bad.select(F.lit("bad").alias("part"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("decimal(18,4)").alias("pnl"))
    )
    return rows.groupBy("part", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").cast("double").alias("pnl"))


@query(
    "write_bars_roundtrip",
    sql("SELECT symbol, CAST(epoch(time) AS BIGINT) AS time, open, high, low, close, tick_volume, round(spread, 6) AS spread FROM bars"),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "export")
    B.write_bars(t.bars_h1(), path, "parquet")
    return rounded(t.spark.read.parquet(path))


def simple_candidates(t: Tables):
    """Grid points scored by the trades that would have passed them; see search_queries for the full view."""
    return (
        t.trades()
        .groupBy("symbol", "regime", "exit_reason")
        .agg(F.sum("pnl").cast("double").alias("ret"), F.count(F.lit(1)).alias("n_trades"))
    )


_CANDS = "SELECT symbol, regime, exit_reason, CAST(sum(pnl) AS DOUBLE) AS ret, count(*) AS n_trades FROM trades GROUP BY 1, 2, 3"


@query("write_candidates_roundtrip", sql("SELECT * FROM cands", cands=_CANDS))
def _(t: Tables):
    path = scratch_dir(t.spark, "candidates")
    P.write_candidates(simple_candidates(t), path)
    back = t.spark.read.option("header", True).schema("regime string, exit_reason string, ret double, n_trades bigint, symbol string").csv(path)
    return back


@query(
    "write_report_roundtrip",
    sql(
        "SELECT symbol, rank, regime, exit_reason, ret, n_all FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, exit_reason) AS rank, count(*) OVER (PARTITION BY symbol) AS n_all FROM cands) WHERE rank <= 3",
        cands=_CANDS,
    ),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "report")
    P.write_report(simple_candidates(t), path, "ret", 3)
    back = t.spark.read.schema("symbol string, n_all bigint, top array<struct<rank: bigint, regime: string, exit_reason: string, ret: double>>").json(path)
    return back.select("symbol", "n_all", F.explode("top").alias("b")).select("symbol", "n_all", "b.*")


def article_json(t: Tables, path: str) -> None:
    """Articles with entities: the language code as entity, and a longer code ending in it."""
    s = F.col("score")
    ents = F.array(
        F.struct(F.upper("lang").alias("symbol"), s.alias("sentiment_score")),
        F.struct(F.concat(F.lit("X:"), F.upper("lang")).alias("symbol"), (s * 0.5).alias("sentiment_score")),
    )
    t.articles().select(
        F.concat(F.lit("a"), F.col("article_id")).alias("uuid"), F.col("text").alias("title"), F.lit("").alias("description"), "source",
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), s.alias("overall_sentiment_score"),
        F.when(F.col("source") != "src1", ents).otherwise(F.array_compact(F.array(ents[0], F.lit(None)))).alias("entities"),
    ).write.json(path)


_ENTS = """SELECT 'a' || article_id AS article_id, time, entity, coalesce(s, 0.0) AS score FROM (
  SELECT article_id, time, upper(lang) AS entity, score AS s FROM articles
  UNION ALL SELECT article_id, time, 'X:' || upper(lang), score * 0.5::DOUBLE FROM articles WHERE source <> 'src1')"""


@query("read_article_json", sql("SELECT * FROM ents", ents=_ENTS))
def _(t: Tables):
    path = scratch_dir(t.spark, "articles")
    article_json(t, path)
    return N.explode_entities(N.read_articles(t.spark, path))


@query(
    "entity_sentiment_json",
    sql("SELECT article_id, round(avg(score), 6) AS sentiment FROM ents GROUP BY 1", ents=_ENTS),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "articles")
    article_json(t, path)
    return N.read_articles(t.spark, path).select("article_id", F.round(N.entity_sentiment(F.col("entities")), 6).alias("sentiment"))


def rss_feed(t: Tables, path: str) -> None:
    """Articles as feed files with the whole text, half of them in CDATA sections; one item in 97 lacks a closing tag."""
    style, broken = F.col("article_id") % 3, F.col("article_id") % 97 == 5
    stamp = (
        F.when(style == 0, F.date_format("time", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
        .when(style == 1, F.date_format("time", "EEE, dd MMM yyyy HH:mm:ss"))
        .otherwise(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    title = F.concat("article_id", F.lit(" "), N.xml_text("source"))
    parts = [
        F.lit("<item><title>"), title, F.when(broken, "").otherwise("</title>"), F.lit("<description>"), N.xml_text("text", F.col("article_id") % 2 == 0),
        F.lit("</description><pubDate>"), stamp, F.lit("</pubDate></item>"),
    ]
    t.articles().select(F.concat(*parts).alias("value")).write.option("maxRecordsPerFile", 20_000).text(path)


@query(
    "read_rss_xml",
    sql("SELECT article_id || ' ' || coalesce(source, '') AS title, article_id || ' ' || coalesce(source, '') || ' ' || coalesce(text, '') AS text, time FROM articles WHERE article_id % 97 <> 5"),
)
def _(t: Tables):
    """Whole document texts through escaping and CDATA; items that can't be parsed don't end the job."""
    path = scratch_dir(t.spark, "rss")
    rss_feed(t, path)
    return N.read_rss(t.spark, path)


@query("read_rss_quarantine", sql("SELECT article_id, length(coalesce(text, '')) AS min_chars FROM articles WHERE article_id % 97 = 5"))
def _(t: Tables):
    """Broken items of the same feed: the id and that the whole text is kept, counted without the markup."""
    path = scratch_dir(t.spark, "rss")
    rss_feed(t, path)
    raw = N.rss_quarantine(t.spark, path)
    body = F.regexp_extract("raw", r"(?s)<description>(.*)</description>", 1)
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&#13;", "\r"), ("<![CDATA[", ""), ("]]>", ""), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(plain))
    return raw.select(F.regexp_extract("raw", r"<title>(\d+)", 1).cast("long").alias("article_id"), F.char_length(body).cast("long").alias("min_chars"))


@query("journal_closed_on_day", sql("SELECT ticket, event, exit_price, CAST(pnl AS DOUBLE) AS pnl FROM journal WHERE CAST(exit_time AS DATE) = DATE '1998-06-15' AND event <> 'OPEN' AND pnl IS NOT NULL"))
def _(t: Tables):
    return J.closed_on(t.journal(), "1998-06-15").select("ticket", "event", "exit_price", F.col("pnl").cast("double").alias("pnl"))


def log_lines(t: Tables):
    level = F.when(F.col("last") > 100, "ERROR").when(F.col("last") > 50, "WARNING").when(F.col("last") > 10, "INFO").otherwise("DEBUG")
    stamp = F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS")
    return t.ticks().select(F.format_string("%s [%s] %s %d", stamp, level, "symbol", "event_id").alias("value"))


@query(
    "tail_log",
    sql(
        """SELECT stamp, level, stamp || ' [' || level || '] ' || symbol || ' ' || event_id AS line FROM (SELECT *, strftime(date_trunc('milliseconds', time), '%Y-%m-%d %H:%M:%S,%g') AS stamp,
CASE WHEN last > 100 THEN 'ERROR' WHEN last > 50 THEN 'WARNING' WHEN last > 10 THEN 'INFO' ELSE 'DEBUG' END AS level FROM ticks)
WHERE level <> 'DEBUG' ORDER BY 1 DESC, 3 DESC LIMIT 60"""
    ),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "log")
    log_lines(t).write.text(path)
    return P.tail_log(t.spark, path)


@query(
    "parse_result_lines",
    sql("SELECT symbol, 8 AS ema_fast, 32 AS ema_slow, 1.5::DOUBLE AS sl, 2.0::DOUBLE AS rr, 25 AS adx, 1.25::DOUBLE AS pf, round(ret, 2) AS ret, CAST(n_trades AS INTEGER) AS n_trades, CAST(n_trades AS DOUBLE) / 2 AS wf_score FROM (SELECT replace(symbol, '#', '') || regime || exit_reason AS symbol, ret, n_trades FROM cands)", cands=_CANDS),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "sweep")
    c = simple_candidates(t)
    name = F.concat(F.regexp_replace("symbol", "#", ""), "regime", "exit_reason")
    line = F.format_string(
        "%s  EMA8/32  SL=1.5 RR=2.0 ADX=25 score=0.60  PF=1.25 Ret=Rs.%s DD=Rs.1.0 WR=50.0%% n=%d  WF=%s windows=4",
        name, F.round("ret", 2).cast("decimal(20,2)"), "n_trades", (F.col("n_trades") / 2).cast("decimal(20,1)"),
    )
    c.select(F.explode(F.array(line, F.concat(F.lit("  BEST for "), name, F.lit(":")))).alias("value")).write.text(path)
    return P.parse_result_lines(t.spark.read.text(path))


@query("top_trades", sql("SELECT symbol, ticket, line, CAST(pnl AS DOUBLE) AS pnl FROM trades ORDER BY pnl DESC, ticket, line, part_id, venue LIMIT 10"))
def _(t: Tables):
    return ranking.top_n(t.trades(), [F.desc("pnl"), "ticket", "line", "part_id", "venue"], 10).select("symbol", "ticket", "line", F.col("pnl").cast("double").alias("pnl"))


@query(
    "top_k_trades_per_symbol",
    sql("SELECT symbol, ticket, line, CAST(pnl AS DOUBLE) AS pnl, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, ticket, line, part_id, venue) AS rank FROM trades) WHERE rank <= 5"),
)
def _(t: Tables):
    out = ranking.top_k_per(t.trades(), ["symbol"], [F.desc("pnl"), "ticket", "line", "part_id", "venue"], 5)
    return out.select("symbol", "ticket", "line", F.col("pnl").cast("double").alias("pnl"), "rank")


@query(
    "last_trades_per_symbol",
    sql("SELECT symbol, ticket, line, CAST(pnl AS DOUBLE) AS pnl, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC, ticket DESC, line DESC, part_id DESC, venue DESC, pnl DESC) AS rank FROM trades) WHERE rank <= 20"),
)
def _(t: Tables):
    out = ranking.last_n(t.trades(), ["symbol"], [F.desc(c) for c in ("time", "ticket", "line", "part_id", "venue", "pnl")], 20)
    return out.select("symbol", "ticket", "line", F.col("pnl").cast("double").alias("pnl"), "rank")


@query(
    "recent_trades",
    sql("SELECT ticket, exit_time, event, CAST(coalesce(pnl, 0) AS DOUBLE) AS pnl FROM journal ORDER BY exit_time DESC NULLS LAST, ticket, line, pnl LIMIT 500"),
)
def _(t: Tables):
    out = ranking.top_n(t.journal(), [F.desc_nulls_last("exit_time"), "ticket", "line", "pnl"], 500)
    return out.select("ticket", "exit_time", "event", F.coalesce(F.col("pnl").cast("double"), F.lit(0.0)).alias("pnl"))


@query("union_all_pages", sql("SELECT 'H4' AS tf, symbol, time, close FROM bars_h4 UNION ALL SELECT 'D1', symbol, time, close FROM bars_d1"))
def _(t: Tables):
    return B.union_all([t.htf(w).select(F.lit(tf).alias("tf"), "symbol", "time", "close") for w, tf in (("4 hours", "H4"), ("1 day", "D1"))])


@query("remaining_symbols", sql("SELECT DISTINCT symbol FROM trades EXCEPT SELECT symbol FROM trades WHERE pnl < -90000"))
def _(t: Tables):
    tr = t.trades()
    return ranking.remaining(tr.select("symbol"), tr.where(F.col("pnl") < -90000).select("symbol"))


@query("distinct_tickets", sql("SELECT DISTINCT ticket FROM journal"))
def _(t: Tables):
    return ranking.distinct_keys(t.journal(), "ticket")


@query("prune_test_tickets", sql("SELECT count(*) AS n, count(DISTINCT ticket) AS tickets FROM journal WHERE ticket NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')"))
def _(t: Tables):
    seeds = t.read("orders").where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_orderkey").alias("ticket"))
    return J.prune_tickets(t.journal(), seeds).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticket").alias("tickets"))
