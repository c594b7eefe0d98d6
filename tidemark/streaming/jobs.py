"""Structured Streaming jobs. Each takes a streaming DataFrame and returns one; sinks are chosen by the caller.

Event times are ``timestamp`` (watermarks reject ``timestamp_ntz``). The gate, the tail risk, the trailing stop and the
confidence drift work on whole micro-batches with the chunk operators and carry one small row per key from batch to
batch (``drain_keyed``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunks import rolling, running
from tidemark.session import scratch_dir, settle

#: Settings of jobs that hold a trace of every row: state lies on the executors' disks and in the checkpoint, and each executor
#: keeps at most so many MB of it in memory, however many keys and partitions there are. Keys are not counted, which would look up
#: each new one once more.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def event_time(df: DataFrame, col: str = "time") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed bars only: a bar leaves once the watermark has passed its end (append mode)."""
    from tidemark.operators.resample import arrival_key

    k = event_time(ticks).withColumn("__k", arrival_key()).withWatermark("time", delay)
    g = k.groupBy(F.window("time", width), "symbol").agg(
        F.min_by("last", "__k").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "__k").alias("close"),
        F.sum("volume").alias("tick_volume"),
    )
    return g.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "tick_volume")


def news_window(articles: DataFrame, width: str = "6 hours", slide: str = "15 minutes") -> DataFrame:
    """Mean score and count per symbol over sliding windows (the batch form; duplicates already removed)."""
    g = articles.groupBy(F.window("time", width, slide), "symbol").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("window.end").cast("timestamp_ntz").alias("as_of"), "score", "n")


def stream_news(articles: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Rolling sentiment; an article counts once per (symbol, source, article) however often it is polled."""
    once = event_time(articles).withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "source", "article_id"])
    return news_window(once)


class KeyedStep(NamedTuple):
    """What a keyed job does with a micro-batch.

    `step(rows, was)` takes the rows of the batch and the carried values (`key` and ``was_<name>``, no row for a new key)
    and gives output rows with `rn` and the new values as ``now_<name>``; those of the last `rn` are carried. A boolean
    `emit` marks the rows that leave the job (without it all do). With `ends`, a key is finished by its first such row:
    it is carried no longer and its later rows are left out. Such rows also have `symbol`, `time` and `since`, the time from
    which the key exists: a key that is not carried is new if it begins after all that its symbol has seen, else finished.
    """

    carried: str
    step: Callable[[DataFrame, DataFrame], DataFrame]
    key: str = "symbol"
    ends: bool = False


def stream_gate(threshold: float = 50.0, buffer: float = 5.0) -> KeyedStep:
    """Hysteresis gate per symbol (rn, score); a null or NaN score reads closed and keeps the state."""
    hi, lo = threshold + buffer / 2, threshold - buffer / 2

    def step(rows: DataFrame, was: DataFrame) -> DataFrame:
        score = F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))
        turn = F.when(score > hi, True).when(score < lo, False)
        out = running(rows.join(was, "symbol", "left"), {"turned": ("last", turn)})
        is_open = F.coalesce("turned", "was_open", F.lit(False))
        return out.select("symbol", "rn", (is_open & score.isNotNull()).alias("gate_open"), is_open.alias("now_open"))

    return KeyedStep("open boolean", step)


def stream_risk(max_dd: float = 8.0, breaker: float = 15.0, cooldown_hours: float = 4.0) -> KeyedStep:
    """Trading permission per symbol (time, rn, equity, tail_event): a tail event or the drawdown limit blocks for the
    cooldown, the breaker blocks for good."""
    pause = int(cooldown_hours * 3600)

    def step(rows: DataFrame, was: DataFrame) -> DataFrame:
        peaks = running(rows.join(was, "symbol", "left"), {"high": ("max", F.col("equity").cast("double"))})
        peak = F.greatest("high", F.coalesce("was_peak", F.lit(0.0)))
        now = F.unix_timestamp("time")
        seen = settle(peaks.withColumn("now_peak", peak).withColumn("dd_pct", (peak - F.col("equity")) / F.greatest(peak, F.lit(1.0)) * 100))
        hit = F.col("tail_event") | (F.col("dd_pct") >= max_dd)
        out = running(seen, {"worst": ("max", F.col("dd_pct")), "blocked": ("max", F.when(hit, now + pause))})
        latched = F.coalesce("was_latched", F.lit(False)) | (F.col("worst") >= breaker)
        until = F.coalesce(F.greatest("blocked", "was_until"), F.lit(0))
        state = [F.col("now_peak"), until.alias("now_until"), latched.alias("now_latched")]
        return out.select("symbol", "rn", "dd_pct", latched.alias("breaker"), (~latched & (now >= until)).alias("allowed"), *state)

    return KeyedStep("peak double, until long, latched boolean", step)


def held_bars(prices: DataFrame, positions: DataFrame) -> DataFrame:
    """Bars (symbol, time, rn, high, low) of a stream from the entry of each position on, one row per ticket and bar."""
    p = positions.select("symbol", F.concat_ws("#", "symbol", "day_no").alias("ticket"), "type", "sl", "atr_entry", F.col("time").cast("timestamp").alias("since"))
    return event_time(prices).join(p, "symbol").where(F.col("time") >= F.col("since"))


def stream_trailing(distance: float = 2.0) -> KeyedStep:
    """Trailing stop per ticket (rows of ``held_bars``): the first bar that breaches it, with the stop.

    The stop is the best price so far less `distance` ATRs, never looser than `sl`; without an ATR it is `sl`.
    """

    def step(rows: DataFrame, was: DataFrame) -> DataFrame:
        long = F.col("type") == "buy"
        # Prices of sales change their sign, so that the best one is the greatest for both sides.
        sign = F.when(long, 1.0).otherwise(-1.0)
        out = running(rows.join(was, "ticket", "left"), {"seen": ("max", F.when(long, F.col("high")).otherwise(-F.col("low")).cast("double"))}, by=["ticket"])
        best = F.greatest("seen", "was_best")
        stop = sign * F.greatest(sign * F.col("sl"), best - distance * F.col("atr_entry"))
        breach = F.coalesce(F.when(long, F.col("low") <= stop).otherwise(F.col("high") >= stop), F.lit(False))
        return out.select("ticket", "rn", F.col("time").alias("breached_at"), stop.alias("stop"), breach.alias("emit"), best.alias("now_best"))

    return KeyedStep("best double", step, "ticket", ends=True)


def stream_drift(head: int = 50, every: int = 20, drop: float = 0.15, floor: float = 0.3) -> KeyedStep:
    """Confidence drift per symbol (rn, conf), checked every `every` rows: mean of the first `head` against the newest
    `head`. A null confidence is left out of the means."""

    def step(rows: DataFrame, was: DataFrame) -> DataFrame:
        kept = was.select("symbol", F.explode(F.arrays_zip("was_rns", "was_newest")).alias("o")).select("symbol", F.col("o.was_rns").alias("rn"), F.col("o.was_newest").alias("conf"), F.lit(False).alias("fresh"))
        both = rows.select("symbol", "rn", F.col("conf").cast("double").alias("conf"), F.lit(True).alias("fresh")).unionByName(kept)
        early = F.when(F.col("fresh") & (F.col("rn") <= head), F.col("conf"))
        per = both.groupBy("symbol").agg(F.max("rn").alias("last"), F.sum(early).alias("total"), F.count(early).alias("known"))
        add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        per = per.join(was.drop("was_rns", "was_newest"), "symbol", "left").select("symbol", "last", add("total", "was_total").alias("now_total"), add("known", "was_known").alias("now_known"))

        def build(df: DataFrame, w) -> DataFrame:
            frame = w.rangeBetween(1 - head, 0)
            # Only the last rows of a symbol are carried, so lists stay empty elsewhere.
            carry = (F.col("rn") > F.col("last") - head) & F.col("conf").isNotNull()
            lists = [F.collect_list(F.when(carry, F.col(c))).over(frame).alias(f"now_{n}") for c, n in (("rn", "rns"), ("conf", "newest"))]
            return df.select("*", F.avg("conf").over(frame).alias("recent"), *lists)

        out = rolling(both.join(per, "symbol"), build, back=head - 1)
        base = F.try_divide("now_total", "now_known")
        drift = (base > floor) & (F.col("recent") < base * (1 - drop))
        check = F.col("fresh") & (F.col("rn") >= head) & (F.col("rn") % every == 0)
        return out.select("symbol", "rn", base.alias("baseline"), "recent", drift.alias("drift"), check.alias("emit"), "now_total", "now_known", "now_rns", "now_newest")

    return KeyedStep("total double, known long, rns array<long>, newest array<double>", step)


def stream_daily_loss(fills: DataFrame, delay: str = "1 day", offset_hours: int = 5) -> DataFrame:
    """Realized result per trading day at a fixed UTC offset (update mode; fold with ``latched_days``).

    A day is an event-time window from one local midnight to the next: once the watermark (`delay` behind the newest
    fill) has passed its end, its state is removed, so state holds the open days only. A fill that comes later still
    changes nothing.
    """
    from tidemark.operators.trades import net_result

    day = F.window("time", "1 day", "1 day", f"{(24 - offset_hours) % 24} hours")
    real = event_time(fills.where(F.col("position_id") != 0)).withWatermark("time", delay)
    g = real.groupBy(day.alias("w")).agg(F.sum(net_result()).alias("net"))
    return g.select(F.to_date(F.col("w.start") + F.expr(f"INTERVAL {offset_hours} HOURS")).alias("day"), "net")


def latched_days(updates: DataFrame, balance: float, limit_pct: float) -> DataFrame:
    """Current net per day out of the update log, and whether the limit was ever hit that day (the halt stays)."""
    loss = -F.col("net").cast("double") / balance * 100
    return updates.groupBy("day").agg(F.max_by("net", "batch").cast("double").alias("net"), F.bool_or(loss >= limit_pct).alias("halt"))


def new_deals(deals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Deals of a stream, each once: equal rows within `delay` are one deal, whose trace then leaves the state."""
    return event_time(deals).withWatermark("time", delay).dropDuplicatesWithinWatermark(deals.columns)


def reconcile_batch(target: str, magic: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler for ``new_deals``: what a batch tells of each position it touches (``position_parts``).

    Nothing earlier is read: parts of a position are merged when asked for. A batch overwrites its own folder only, so
    repeating it changes nothing.
    """
    from tidemark.operators.trades import position_parts

    def handle(batch: DataFrame, batch_id: int) -> None:
        deals = batch.withColumn("time", F.col("time").cast("timestamp_ntz"))
        position_parts(deals, magic).write.mode("overwrite").parquet(f"{target}/parts/batch={batch_id}")

    return handle


def reconciled(spark: SparkSession, target: str, known: DataFrame) -> DataFrame:
    """The foreign positions as of the newest batch of ``reconcile_batch``: one row each."""
    from tidemark.operators.trades import external_rows, merged_parts

    return external_rows(merged_parts(spark.read.parquet(f"{target}/parts").drop("batch")), known)


# --- running a job to completion over what a source holds -----------------------------------------------------------


class Replay(NamedTuple):
    """A stream over a folder, and the steps that put the next files there."""

    stream: DataFrame
    feed: Callable[[], Iterator[int]]

    def through(self, change: Callable[[DataFrame], DataFrame]) -> Replay:
        return Replay(change(self.stream), self.feed)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings; those it had come back at the end."""
    had = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(
    source: DataFrame | Replay, name: str, handler: Callable[[DataFrame, int], None] | None = None, mode: str = "append", progress: list | None = None, conf: Mapping[str, str] | None = None
) -> DataFrame | None:
    """Process everything available, then stop. Rows go to a parquet table below the checkpoint folder.

    A replay is processed part by part: the job starts anew from its checkpoint after each one. `progress` gets the last
    report of every run. `conf` holds for the job alone, which keeps the settings it was started with.
    """
    stream, feed = source if isinstance(source, Replay) else (source, lambda: iter([0]))
    spark = stream.sparkSession
    root = scratch_dir(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    for _ in feed():
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        with settings(spark, conf or {}):
            if handler is not None:
                query = writer.foreachBatch(handler).start()
            elif mode == "append":
                query = writer.format("parquet").option("path", f"{root}/rows").start()
            else:
                query = writer.foreachBatch(keep).start()
        query.awaitTermination()
        if progress is not None:
            progress.append(query.lastProgress)
    return None if handler is not None else spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(f"{root}/rows")


def drain_keyed(source: DataFrame | Replay, name: str, job: KeyedStep) -> DataFrame:
    """Run a keyed job over everything available; returns its output rows.

    Rows have the job's key and `rn`, their position in the symbol. A batch reads the carry of the batch before, one row
    per key, and no earlier output; carries take turns in two folders, so a repeated batch finds what it began with. A
    row that arrives after later ones of its key is judged with the state carried so far and changes no earlier output.
    """
    stream = source.stream if isinstance(source, Replay) else source
    root, key = scratch_dir(stream.sparkSession, name), job.key
    names = [part.split()[0] for part in job.carried.split(",")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = lambda what, schema, n: spark.read.schema(schema).parquet(f"{root}/{what}/{n % 2}") if batch_id else spark.createDataFrame([], schema)
        held = own("carry", f"{key} string, {job.carried}", batch_id + 1)
        if job.ends:
            seen = own("seen", "symbol string, __upto timestamp", batch_id + 1)
            highest = batch.groupBy("symbol").agg(F.max("time").alias("__upto")).unionByName(seen).groupBy("symbol").agg(F.max("__upto").alias("__upto"))
            highest.write.mode("overwrite").parquet(f"{root}/seen/{batch_id % 2}")
            known = held.select(key, F.lit(True).alias("__held"))
            batch = batch.join(known, key, "left").join(seen, "symbol", "left")
            batch = batch.where(F.col("__held") | F.col("__upto").isNull() | (F.col("since") > F.col("__upto"))).drop("__held", "__upto", "symbol", "since")
        out = settle(job.step(batch, held.select(key, *[F.col(c).alias(f"was_{c}") for c in names])))
        # One struct per key, so that a null in a carried value is carried as well.
        last = out.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"now_{c}").alias(c) for c in names]), "rn").alias("s")).select(key, "s.*")
        rows = (out.where("emit").drop("emit") if "emit" in out.columns else out).drop(*[f"now_{c}" for c in names])
        carry = last.unionByName(held.join(last, key, "left_anti"))
        if job.ends:
            firsts = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "rn").alias("s"))
            rows = firsts.select(key, "s.*")
            carry = carry.join(rows, key, "left_anti").select(key, *names)
        carry.write.mode("overwrite").parquet(f"{root}/carry/{batch_id % 2}")
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    drain(source, name, handle)
    return stream.sparkSession.read.parquet(f"{root}/rows").drop("batch")


def replay(df: DataFrame, name: str, cut: Column, parts: int) -> Replay:
    """`df` as a stream that grows by one part at a time, in the order of `cut` (0 .. parts - 1).

    Each part is written by as many tasks as read it, to as many files. A row whose `cut` is null or not one of the parts
    is an error.
    """
    spark = df.sparkSession
    if not df.where(cut.isNull() | (cut < 0) | (cut >= parts)).isEmpty():
        raise ValueError("rows outside the parts of the replay")
    path = scratch_dir(spark, name)

    def feed() -> Iterator[int]:
        for i in range(parts):
            df.where(cut == i).write.mode("append").parquet(path)
            yield i

    df.limit(0).write.parquet(path)  # the folder has to be there before the stream is declared
    return Replay(spark.readStream.schema(df.schema).parquet(path), feed)


def by_time(df: DataFrame, parts: int, col: str = "time") -> Column:
    """Which of `parts` equal ranges of the table's own times a row belongs to."""
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    low, high = df.agg(F.min(at(col)), F.max(at(col))).first()
    low, high = (0, 0) if low is None else (low, high)
    return F.floor((at(col) - low) * parts / (high - low + 1))
