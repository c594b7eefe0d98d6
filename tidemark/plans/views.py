"""Market views over the given tables, once as DataFrames and once as SQL text for the checking engine.

ticks   <- events                     (symbol = event_type)
bars    <- ticks by hour, numbered     bars_h4 / bars_d1 / bars_m1 likewise
trades  <- lineitem join part          (symbol = p_brand), exact decimal pnl
journal <- orders and lineitem         OPEN row per order, closing row per line
deals   <- lineitem join part          broker fills
articles<- documents left join labels
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import floor_time, month_of
from tidemark.operators.chunks import index_rows
from tidemark.operators.resample import bars_from_ticks, resample
from tidemark.session import prepare, settle

ORDER_BLOCK = 1 << 20


class Tables:
    """The given tables of one folder and the views built on them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = prepare(spark)
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def ticks(self) -> DataFrame:
        half = (F.lit(1) + F.col("user_id") % 5) * 0.005
        return self.read("events").select(
            F.col("event_type").alias("symbol"),
            F.col("ts").alias("time"),
            "event_id",
            F.col("value").alias("last"),
            F.lit(1).alias("volume"),
            (F.col("value") - half).alias("bid"),
            (F.col("value") + half).alias("ask"),
            ((F.lit(1) + F.col("user_id") % 5)).cast("double").alias("spread"),
        )

    def bars_h1(self) -> DataFrame:
        return bars_from_ticks(self.ticks(), "1 hour")

    def bars(self) -> DataFrame:
        """Hourly bars with row numbers, written once: at most 744 rows per (symbol, month)."""
        return settle(index_rows(self.bars_h1(), ["symbol"], [month_of("time")], ["time"]))

    def bars_m1(self) -> DataFrame:
        return bars_from_ticks(self.ticks(), "1 minute")

    def htf(self, width: str) -> DataFrame:
        """Coarser bars with row numbers and the time at which each is complete."""
        out = resample(self.bars_h1(), width).withColumn("available_at", F.col("time") + F.expr(f"INTERVAL {width}"))
        return settle(index_rows(out, ["symbol"], [F.year("time")], ["time"]))

    def trades(self) -> DataFrame:
        li, part = self.read("lineitem"), self.read("part").select("p_partkey", "p_brand", "p_retailprice")
        pnl = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * F.col("p_retailprice")
        return li.join(part, li.l_partkey == part.p_partkey).select(
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").alias("time"),
            F.col("l_orderkey").alias("ticket"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("venue"),
            F.col("l_quantity").alias("volume"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_tax").alias("tax"),
            F.round(pnl, 4).cast("decimal(18,4)").alias("pnl"),
            F.col("l_returnflag").alias("regime"),
            F.col("l_linestatus").alias("exit_reason"),
        )

    TRADE_ORDER = ("time", "ticket", "line", "part_id", "venue", "volume", "price", "pnl", "tax", "regime", "exit_reason")

    def numbered_trades(self, by=("symbol",), keep=("*",)) -> DataFrame:
        """Trades numbered in time order per `by` key; the second bucket bounds a crowded day. Only columns to `keep` are
        written."""
        buckets = [F.to_date("time"), F.floor(F.col("ticket") / ORDER_BLOCK)]
        return settle(index_rows(self.trades(), list(by), buckets, list(self.TRADE_ORDER)).select(*keep))

    def journal(self) -> DataFrame:
        null = lambda t: F.lit(None).cast(t)
        long = F.col("o_custkey") % 2 == 0
        opens = self.read("orders").select(
            F.col("o_orderkey").alias("ticket"),
            F.substring("o_orderpriority", 1, 1).alias("symbol"),
            F.when(long, "buy").otherwise("sell").alias("type"),
            F.lit(0.1).alias("volume"),
            F.col("o_totalprice").alias("entry_price"),
            (F.col("o_totalprice") * F.when(long, 0.98).otherwise(1.02)).alias("sl"),
            (F.col("o_totalprice") * F.when(long, 1.04).otherwise(0.96)).alias("tp"),
            F.col("o_orderdate").alias("entry_time"),
            null("double").alias("exit_price"),
            null("timestamp_ntz").alias("exit_time"),
            null("decimal(18,4)").alias("pnl"),
            null("int").alias("line"),
            F.lit("OPEN").alias("event"),
        )
        event = F.element_at(F.array(*[F.lit(e) for e in EVENTS]), (F.col("line") % 7 + 1).cast("int"))
        closes = self.trades().select(
            "ticket",
            null("string").alias("symbol"),
            null("string").alias("type"),
            null("double").alias("volume"),
            null("double").alias("entry_price"),
            null("double").alias("sl"),
            null("double").alias("tp"),
            null("timestamp_ntz").alias("entry_time"),
            F.col("price").alias("exit_price"),
            F.col("time").alias("exit_time"),
            "pnl",
            "line",
            event.alias("event"),
        )
        return opens.unionByName(closes)

    def closed(self) -> DataFrame:
        return self.journal().where(F.col("event").isin("CLOSE", "REVERSAL", "MR_EXIT"))

    def deals(self) -> DataFrame:
        cents = lambda c: F.round(c, 4).cast("decimal(18,4)")
        return self.trades().select(
            F.col("ticket").alias("position_id"),
            "symbol",
            "time",
            F.col("line").alias("deal_no"),
            "part_id",
            "venue",
            (F.col("line") % 2).alias("type"),
            "price",
            "volume",
            F.col("pnl").alias("profit"),
            cents(-F.col("tax") * 100).alias("commission"),
            cents(F.lit(0.0)).alias("swap"),
            F.when(F.col("regime") == "N", 20240).otherwise(0).alias("magic"),
        )

    def positions(self) -> DataFrame:
        """One position per symbol and day, opened on the day's first bar in that bar's direction."""
        from tidemark.operators.sizing import daily_open_positions

        return daily_open_positions(self.bars_h1())

    def symbol_meta(self) -> DataFrame:
        return _meta(self.read("part").select(F.col("p_brand").alias("symbol")).distinct())

    def event_meta(self) -> DataFrame:
        return _meta(self.read("events").select(F.col("event_type").alias("symbol")).distinct())

    def articles(self) -> DataFrame:
        """Documents as news: published one minute apart in id order, scored by the quality label where known."""
        docs, labels = self.read("documents"), self.read("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("article_id"),
            "text",
            "lang",
            "source",
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("time"),
            (F.col("q") * 2.0 - 1.0).alias("score"),
        )

    def keywords(self) -> DataFrame:
        return self.spark.createDataFrame(KEYWORDS, "keyword string, symbol string")


def _meta(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "symbol",
        F.lit(0.01).alias("point"),
        F.lit(0.01).alias("tick_size"),
        F.lit(1.0).alias("tick_value"),
        F.lit(0.01).alias("volume_step"),
        F.lit(0.01).alias("volume_min"),
        F.lit(100.0).alias("volume_max"),
    )


EVENTS = ("CLOSE", "CLOSE", "SCALE_OUT", "CHANDELIER", "REVERSAL", "MR_EXIT", "MANUAL_CLOSE")
KEYWORDS = [("the", "EN_IDX"), ("of", "EN_IDX"), ("les", "FR_IDX"), ("une", "FR_IDX"), ("der", "DE_IDX"), ("und", "DE_IDX"), ("los", "ES_IDX"), ("del", "ES_IDX"), ("in that", "EN_PAIR")]

_PNL = "CAST(round(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice, 4) AS DECIMAL(18,4))"


def _bars_sql(unit: str) -> str:
    return f"""SELECT event_type AS symbol, date_trunc('{unit}', ts) AS time, first(value ORDER BY ts, event_id) AS open,
  max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS tick_volume,
  avg(CAST(1 + user_id % 5 AS DOUBLE)) AS spread FROM events GROUP BY 1, 2"""


def _htf_sql(bucket: str, width: str) -> str:
    return f"""SELECT *, time + INTERVAL {width} AS available_at, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM (
  SELECT symbol, {bucket} AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY time) AS close, sum(tick_volume) AS tick_volume FROM bars GROUP BY symbol, {bucket})"""


VIEWS = {
    "ticks": """SELECT event_type AS symbol, ts AS time, event_id, value AS last, 1 AS volume, value - (1 + user_id % 5) * 0.005 AS bid,
  value + (1 + user_id % 5) * 0.005 AS ask FROM events""",
    "bars": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM ({_bars_sql('hour')})",
    "bars_m1": _bars_sql("minute"),
    "bars_h4": _htf_sql("time_bucket(INTERVAL 4 HOURS, time, TIMESTAMP '2000-01-01')", "4 HOURS"),
    "bars_d1": _htf_sql("date_trunc('day', time)", "1 DAY"),
    "trades": f"""SELECT p_brand AS symbol, l_shipdate AS time, l_orderkey AS ticket, l_linenumber AS line, l_partkey AS part_id,
  l_suppkey AS venue, l_quantity AS volume, l_extendedprice AS price, l_tax AS tax, {_PNL} AS pnl, l_returnflag AS regime,
  l_linestatus AS exit_reason FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time, ticket, line, part_id, venue, volume, price, pnl, tax,
  regime, exit_reason) AS rn FROM trades""",
    "journal": """SELECT o_orderkey AS ticket, substr(o_orderpriority, 1, 1) AS symbol,
  CASE WHEN o_custkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS type, CAST(0.1 AS DOUBLE) AS volume, o_totalprice AS entry_price,
  o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 0.98::DOUBLE ELSE 1.02::DOUBLE END AS sl,
  o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 1.04::DOUBLE ELSE 0.96::DOUBLE END AS tp,
  o_orderdate AS entry_time, NULL::DOUBLE AS exit_price, NULL::TIMESTAMP AS exit_time, NULL::DECIMAL(18,4) AS pnl, NULL::INTEGER AS line,
  'OPEN' AS event FROM orders
  UNION ALL SELECT ticket, NULL, NULL, NULL, NULL, NULL, NULL, NULL, price, time, pnl, line,
  ['CLOSE','CLOSE','SCALE_OUT','CHANDELIER','REVERSAL','MR_EXIT','MANUAL_CLOSE'][line % 7 + 1] FROM trades""",
    "closed": "SELECT * FROM journal WHERE event IN ('CLOSE','REVERSAL','MR_EXIT')",
    "deals": """SELECT ticket AS position_id, symbol, time, line AS deal_no, part_id, venue, line % 2 AS type, price, volume, pnl AS profit,
  CAST(round(-tax * 100, 4) AS DECIMAL(18,4)) AS commission, 0::DECIMAL(18,4) AS swap,
  CASE WHEN regime = 'N' THEN 20240 ELSE 0 END AS magic FROM trades""",
    "positions": """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) AS day_no, time,
  CASE WHEN close >= open THEN 'buy' ELSE 'sell' END AS type, 1.0::DOUBLE AS volume, close AS price_open,
  CASE WHEN close >= open THEN close - greatest(high - low, 1.0) ELSE close + greatest(high - low, 1.0) END AS sl,
  CASE WHEN close >= open THEN close + 2 * greatest(high - low, 1.0) ELSE close - 2 * greatest(high - low, 1.0) END AS tp,
  greatest(high - low, 1.0) AS atr_entry
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time) AS k FROM bars) WHERE k = 1""",
    "articles": """SELECT d.doc_id AS article_id, text, lang, source, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS time,
  q * 2.0::DOUBLE - 1.0::DOUBLE AS score FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""",
    "keywords": "SELECT * FROM (VALUES " + ", ".join(f"('{k}','{s}')" for k, s in KEYWORDS) + ") t(keyword, symbol)",
    "symbol_meta": "SELECT DISTINCT p_brand AS symbol, 0.01::DOUBLE AS point, 0.01::DOUBLE AS tick_size, 1.0::DOUBLE AS tick_value, 0.01::DOUBLE AS volume_step, 0.01::DOUBLE AS volume_min, 100.0::DOUBLE AS volume_max FROM part",
    "event_meta": "SELECT DISTINCT event_type AS symbol, 0.01::DOUBLE AS point, 0.01::DOUBLE AS tick_size, 1.0::DOUBLE AS tick_value, 0.01::DOUBLE AS volume_step, 0.01::DOUBLE AS volume_min, 100.0::DOUBLE AS volume_max FROM events",
}


def sql(body: str, **ctes: str) -> str:
    """`body` preceded by the views it names and by extra CTEs (in the order given)."""
    text = body + " " + " ".join(ctes.values())
    used: list[str] = []

    def need(name: str):
        if name in used:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                need(other)
        used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            need(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in used]
    recursive = False
    for n, q in ctes.items():
        rec = q.lstrip().startswith("--rec")
        recursive |= rec
        parts.append(f"{n} AS ({q.replace('--rec', '')})" if rec else f"{n} AS MATERIALIZED ({q})")
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def rec_cte(name: str, src: str, init: dict[str, str], step: dict[str, str]) -> dict[str, str]:
    """Recursive CTE walking `src` row by row per symbol; `p` is the previous state, `b` the current row."""
    first = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in init.items())
    later = ", ".join(f"CAST({e} AS DOUBLE)" for e in step.values())
    return {
        name: f"""--rec SELECT b.symbol, b.rn, {first} FROM {src} b WHERE b.rn = 1
  UNION ALL SELECT b.symbol, b.rn, {later} FROM {name} p JOIN {src} b ON b.symbol = p.symbol AND b.rn = p.rn + 1"""
    }
