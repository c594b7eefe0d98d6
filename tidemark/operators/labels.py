"""First-touch labels and outcomes over bounded forward windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import TINY
from tidemark.operators.chunks import CHUNK_ROWS, chunk_of, rolling, running
from tidemark.session import settle

#: Positions counted from behind are this minus the row number.
BEHIND = 1 << 40


def label_params(resolved: DataFrame, sl_key: str = "sl", rr_key: str = "rr") -> DataFrame:
    """Barrier multiples per symbol from resolved parameters: sl and sl * rr."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return resolved.groupBy("symbol").agg(pick(sl_key).alias("sl_atr"), (pick(sl_key) * pick(rr_key)).alias("tp_atr"))


def _touches(hold: int):
    """Array of the next `hold` bars and the first one that reaches a barrier."""

    def build(d, w):
        ahead = F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, hold))
        return d.withColumn("__next", ahead).withColumn("__exit", F.lead("close", hold).over(w))

    return build


def _first_hit(up: Column, down: Column) -> Column:
    hits = F.filter("__next", lambda b: (b["high"] >= up) | (b["low"] <= down))
    first = F.try_element_at(hits, F.lit(1))
    return F.when(first["high"] >= up, 1).when(first["low"] <= down, -1)


def triple_barrier(df: DataFrame, tp: float = 2.0, sl: float = 1.0, hold: int = 20, atr: str = "atr_14", rows: int | None = None) -> DataFrame:
    """+1 / -1 for the first ATR barrier reached within `hold` bars (both in one bar: +1), null when none is.

    The last `hold` bars of a symbol and bars without a positive ATR have no label.
    """
    out = rolling(df, _touches(hold), ahead=hold, rows=rows)
    usable = (F.size("__next") == hold) & (F.col(atr) > 0)
    hit = _first_hit(F.col("close") + F.col(atr) * tp, F.col("close") - F.col(atr) * sl)
    return out.withColumn("label", F.when(usable, hit)).drop("__next", "__exit")


def r_multiple(df: DataFrame, tp: float = 2.0, sl: float = 1.0, hold: int = 20, atr: str = "atr_14", rows: int | None = None) -> DataFrame:
    """Realised multiple of the risk: tp/sl up, -1 down, else the move after `hold` bars over the risk."""
    out = rolling(df, _touches(hold), ahead=hold, rows=rows)
    usable = (F.size("__next") == hold) & (F.col(atr) > 0)
    hit = _first_hit(F.col("close") + F.col(atr) * tp, F.col("close") - F.col(atr) * sl)
    rr = tp / sl if sl > 0 else 2.0
    timeout = (F.col("__exit") - F.col("close")) / F.greatest(F.col(atr) * sl, F.lit(TINY))
    value = F.when(hit == 1, rr).when(hit == -1, -1.0).otherwise(timeout)
    return out.withColumn("r_multiple", F.when(usable, value)).drop("__next", "__exit")


def first_touch(signals: DataFrame, bars: DataFrame, keys: Sequence[str], spans: Sequence[int] = (65_536, 256)) -> DataFrame:
    """First bar in (rn, until_rn] at which a signal's sl or tp is reached; the stop wins inside one bar.

    Bars are summed up by spans of rows, coarse to fine. At each level a signal meets the highest high and lowest low of
    the spans left to it, and keeps two: the one it begins in and the first later one that reaches a level. Only the
    bars of two finest spans are then looked at, however long the signal lives. Each range join is an equality on the
    span. Adds touch_rn and touch ("SL" / "TP"), null when untouched.
    """
    ids = ["symbol", *keys, "rn"]
    long = F.col("signal") == "buy"
    hit_sl = F.when(long, F.col("__low") <= F.col("sl")).otherwise(F.col("__high") >= F.col("sl"))
    hit_tp = F.when(long, F.col("__high") >= F.col("tp")).otherwise(F.col("__low") <= F.col("tp"))
    # Rows (__from, __to] that may hold the first touch.
    left = signals.select(*ids, "signal", "sl", "tp", F.col("rn").alias("__from"), F.col("until_rn").alias("__to")).where("__from < __to")
    for span in spans:
        block = lambda c: F.floor((c - 1) / span).cast("long")  # noqa: B023, E731
        sums = bars.groupBy("symbol", block(F.col("rn")).alias("__block")).agg(F.max("high").alias("__high"), F.min("low").alias("__low"))
        own = block(F.col("rn") + 1)
        spread = left.withColumn("__block", F.explode(F.sequence(block(F.col("__from") + 1), block(F.col("__to")))))
        met = spread.join(sums, ["symbol", "__block"]).where((F.col("__block") == own) | hit_sl | hit_tp)
        kept = met.groupBy(*ids).agg(
            *[F.first(c).alias(c) for c in ("signal", "sl", "tp")], F.max(F.when(F.col("__block") == own, F.col("__to"))).alias("__own_to"),
            F.min(F.when(F.col("__block") > own, F.struct("__block", "__to"))).alias("__later"),
        )
        begin, later = F.least("__own_to", (own + 1) * span), F.col("__later.__block") * span
        parts = F.array(F.struct(F.col("rn").alias("a"), begin.alias("b")), F.struct(later.alias("a"), F.least("__later.__to", later + span).alias("b")))
        left = kept.select(*ids, "signal", "sl", "tp", F.explode(parts).alias("p")).select(*ids, "signal", "sl", "tp", F.col("p.a").alias("__from"), F.col("p.b").alias("__to")).where("__from < __to")
    b = bars.select("symbol", block(F.col("rn")).alias("__block"), F.col("rn").alias("bar_rn"), F.col("high").alias("__high"), F.col("low").alias("__low"))
    ends = left.withColumn("__block", block(F.col("__to")))
    met = ends.join(b, ["symbol", "__block"]).where((F.col("bar_rn") > F.col("__from")) & (F.col("bar_rn") <= F.col("__to")) & (hit_sl | hit_tp))
    first = met.groupBy(*ids).agg(F.min("bar_rn").alias("touch_rn"), F.min_by(hit_sl, "bar_rn").alias("__sl"))
    first = first.withColumn("touch", F.when(F.col("__sl"), "SL").otherwise("TP")).drop("__sl")
    return signals.join(first, ids, "left")


def signal_outcome(signals: DataFrame, bars: DataFrame, sl_mult: float, rr: float, point: float = 0.01, horizon: int = 400) -> DataFrame:
    """+rr / -1 / 0 of every signal from its stop and target within the next horizon - 1 bars."""
    sl_points = F.greatest(F.floor(F.col("atr") * sl_mult / point), F.lit(1))
    tp_points = F.floor(sl_points * rr)
    side = F.when(F.col("signal") == "buy", 1.0).otherwise(-1.0)
    s = signals.withColumn("sl", F.col("close") - side * sl_points * point).withColumn("tp", F.col("close") + side * tp_points * point)
    s = first_touch(s.withColumn("until_rn", F.col("rn") + horizon - 1), bars, [])
    return s.withColumn("r", F.when(F.col("touch") == "SL", -1.0).when(F.col("touch") == "TP", float(rr)).otherwise(0.0))


def _hops(rn: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Number of the next signal taken after each one, by row number in order; the number of signals if there is none."""
    return np.maximum(np.searchsorted(rn, free), np.arange(1, len(rn) + 1))


def _taken(signals: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """The signals (by, rn, free_rn) of the chain that begins at the first one of a key and goes on from each to the
    first one at or after its free_rn.

    Within a chunk of rows the chain from any signal is followed at once, up to where it leaves the chunk. The first
    signals behind these places, one or a few per chunk, are linked and walked by doubling the steps; that tells at
    which signal the chain enters each chunk, and a second pass over the chunks takes it from there.
    """
    by, size = list(by), rows or CHUNK_ROWS
    chunked = signals.select(*by, F.col("rn").cast("long").alias("rn"), F.col("free_rn").cast("long").alias("free_rn")).withColumn("chunk", chunk_of(rows))

    def leave(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        rn, free = table["rn"].to_numpy(), table["free_rn"].to_numpy()
        hop, at = _hops(rn, free), np.arange(len(rn))
        end = np.where(hop < len(rn), np.minimum(hop, len(rn) - 1), at)
        while not np.array_equal(nxt := end[end], end):
            end = nxt
        past = np.maximum(free[end], (table["chunk"][0].as_py() + 1) * size + 1)
        return table.append_column("leave", pa.array(past, pa.int64()))

    schema = T.StructType([*chunked.schema.fields, T.StructField("leave", T.LongType())])
    ways = settle(chunked.groupBy(*by, "chunk").applyInArrow(leave, schema))
    # First signal at or after each place, seen from behind; a signal comes before a place on its own row.
    behind = lambda c, place: (F.lit(BEHIND) - F.col(c)) * 2 + place
    places = ways.select(*by, F.col("leave").alias("at")).distinct()
    line = ways.select(*by, F.lit(None).cast("long").alias("at"), F.col("rn").alias("own"), behind("rn", 0).alias("rn")).unionByName(places.select(*by, "at", F.lit(None).cast("long").alias("own"), behind("at", 1).alias("rn")))
    entries = running(line, {"to": ("last", F.col("own"))}, by, rows).where("at is not null and to is not null").select(*by, F.col("at").alias("leave"), "to")
    starts = ways.groupBy(*by).agg(F.min("rn").alias("rn"))
    nodes = entries.select(*by, F.col("to").alias("rn")).unionByName(starts).distinct()
    jump = settle(ways.select(*by, "rn", "leave").join(nodes, [*by, "rn"]).join(entries, [*by, "leave"]).select(*by, "rn", "to"))
    reached = starts
    while not jump.isEmpty():
        reached = settle(reached.unionByName(reached.join(jump, [*by, "rn"]).select(*by, F.col("to").alias("rn"))).distinct())
        jump = settle(jump.join(jump.select(*by, F.col("rn").alias("to"), F.col("to").alias("__to")), [*by, "to"]).select(*by, "rn", F.col("__to").alias("to")))
    marked = ways.drop("leave").join(reached.withColumn("enter", F.lit(True)), [*by, "rn"], "left").select(*chunked.columns, "enter")

    def take(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        hop, taken = _hops(table["rn"].to_numpy(), table["free_rn"].to_numpy()).tolist(), []
        i = next((k for k, flag in enumerate(table["enter"].to_pylist()) if flag), len(hop))
        while i < len(hop):
            taken.append(i)
            i = hop[i]
        return table.take(pa.array(taken, pa.int64())).select([*by, "rn"])

    return marked.groupBy(*by, "chunk").applyInArrow(take, chunked.select(*by, "rn").schema)


def non_overlapping_trades(signals: DataFrame, bars: DataFrame, keys: Sequence[str] = ("param_id",), point: float = 0.01, tick_value: float = 0.01, rows: int | None = None) -> DataFrame:
    """One position at a time per (symbol, keys): entry at the signal's close, exit at the first stop or target, at the
    close of an opposite signal, or at the last bar.

    Outcomes are joins and chunked scans; which signals find the book empty is chosen chunk by chunk (``_taken``). A stop
    or target exit blocks entries on its own bar, an opposite signal does not.
    """
    keys = list(keys)
    other = lambda side: ("last", F.when(F.col("signal") == side, F.lit(BEHIND) - F.col("rn")))
    turned = signals.withColumn("rn", F.lit(BEHIND) - F.col("rn"))
    last = bars.groupBy("symbol").agg(F.max("rn").alias("last_rn"))
    s = running(turned, {"__sell": other("sell"), "__buy": other("buy")}, ["symbol", *keys], rows).withColumn("rn", F.lit(BEHIND) - F.col("rn"))
    s = s.withColumn("opp_rn", F.when(F.col("signal") == "buy", F.col("__sell")).otherwise(F.col("__buy"))).drop("__sell", "__buy").join(last, "symbol")
    s = s.withColumn("until_rn", F.coalesce("opp_rn", "last_rn"))
    t = first_touch(settle(s), bars, keys).withColumn("exit_rn", F.coalesce("touch_rn", "until_rn"))
    reason = F.coalesce("touch", F.when(F.col("opp_rn").isNotNull(), "REVERSE").otherwise("END"))
    t = t.withColumn("exit_reason", reason).withColumn("free_rn", F.when(F.col("touch_rn").isNotNull(), F.col("exit_rn") + 1).otherwise(F.col("exit_rn")))
    t = settle(t)
    chosen = _taken(t, ["symbol", *keys], rows)
    exits = bars.select("symbol", F.col("rn").alias("exit_rn"), F.col("close").alias("__exit_close"), F.col("time").alias("exit_time"))
    picked = t.join(chosen, ["symbol", *keys, "rn"]).join(exits, ["symbol", "exit_rn"], "left")
    price = F.when(F.col("touch") == "SL", F.col("sl")).when(F.col("touch") == "TP", F.col("tp")).otherwise(F.col("__exit_close"))
    side = F.when(F.col("signal") == "buy", 1.0).otherwise(-1.0)
    out = picked.withColumn("exit", price)
    return out.select(
        "symbol", *keys, F.col("signal").alias("type"), F.col("rn").alias("entry_rn"), "exit_rn", "exit_time", F.col("close").alias("entry"), "exit", "sl", "tp",
        "exit_reason", ((F.col("exit") - F.col("close")) * side / point * tick_value).alias("pnl"),
    )
