"""Keyed streams: rows of a key out of order in a micro-batch, over many files and several batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_dir, settle
from tidemark.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def stream_of(spark, rows, schema, cuts):
    """Rows as a stream: micro-batch i takes the rows below cuts[i], scattered over four files."""
    path, low = scratch_dir(spark, "stream"), 0
    for high in cuts:
        spark.createDataFrame(rows[low:high], schema).repartition(4, F.hash("rn")).write.mode("append").parquet(path)
        low = high
    files = spark.read.parquet(path).inputFiles()
    assert len(files) > len(cuts)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gate(spark, small_batches):
    rng = np.random.default_rng(3)
    score = [None if x < 5 else float("nan") if x > 95 else float(x) for x in rng.uniform(0, 100, 400)]
    stream = stream_of(spark, [("S", i + 1, s) for i, s in enumerate(score)], "symbol string, rn long, score double", (150, 290, 400))
    got = {r.rn: r.gate_open for r in J.drain_keyed(stream, "gate", J.stream_gate(50.0, 40.0)).collect()}
    is_open, want = False, {}
    for i, s in enumerate(score, 1):
        known = s is not None and s == s
        if known:
            is_open = s >= 30 if is_open else s > 70
        want[i] = known and is_open
    assert got == want


def test_tail_risk(spark, small_batches):
    rng = np.random.default_rng(5)
    equity = (100 + rng.normal(0, 2, 400).cumsum()).tolist()
    tail = (rng.uniform(0, 1, 400) < 0.02).tolist()
    rows = [("S", i + 1, START + dt.timedelta(hours=i), e, t) for i, (e, t) in enumerate(zip(equity, tail))]
    stream = stream_of(spark, rows, "symbol string, rn long, time timestamp, equity double, tail_event boolean", (120, 260, 400))
    got = {r.rn: (round(r.dd_pct, 9), r.breaker, r.allowed) for r in J.drain_keyed(stream, "risk", J.stream_risk(6.0, 25.0, 4.0)).collect()}
    peak, until, latched, want = 0.0, -1, False, {}
    for i, (e, t) in enumerate(zip(equity, tail)):
        peak = max(peak, e)
        dd = (peak - e) / max(peak, 1.0) * 100
        latched = latched or dd >= 25.0
        if t or dd >= 6.0:
            until = i + 4
        want[i + 1] = (round(dd, 9), latched, not latched and i >= until)
    assert got == want


def test_drift(spark, small_batches):
    rng = np.random.default_rng(7)
    conf = [None if x < 0.05 else float(x) for x in rng.uniform(0, 1, 400) * np.linspace(1, 0.6, 400)]
    rows = [("S", i + 1, c) for i, c in enumerate(conf)]
    stream = stream_of(spark, rows, "symbol string, rn long, conf double", (30, 155, 400))
    got = {r.rn: (round(r.baseline, 9), round(r.recent, 9), r.drift) for r in J.drain_keyed(stream, "drift", J.stream_drift()).collect()}
    mean = lambda part: float(np.mean([c for c in part if c is not None]))
    base, want = mean(conf[:50]), {}
    for n in range(60, 401, 20):
        recent = mean(conf[n - 50 : n])
        want[n] = (round(base, 9), round(recent, 9), base > 0.3 and recent < base * 0.85)
    assert got == want and len({w[2] for w in want.values()}) == 2


def test_trailing_stop(spark, small_batches):
    rng = np.random.default_rng(11)
    close = 100 + rng.normal(0, 1, 300).cumsum()
    rows = [("S", START + dt.timedelta(hours=i), i + 1, c + 0.5, c - 0.5) for i, c in enumerate(close.tolist())]
    opened = [(day, rows[at], side) for day, (at, side) in enumerate([(0, "buy"), (10, "sell"), (90, "buy"), (95, "sell"), (298, "buy")])]
    held = [("S", day, side, r[4] - 8 if side == "buy" else r[3] + 8, None if day == 3 else 2.0, r[1]) for day, r, side in opened]
    positions = spark.createDataFrame(held, "symbol string, day_no long, type string, sl double, atr_entry double, time timestamp")
    stream = stream_of(spark, rows, "symbol string, time timestamp, rn long, high double, low double", (100, 200, 300))
    out = J.drain_keyed(J.held_bars(stream, positions), "trailing", J.stream_trailing())
    got = {r.ticket: (r.breached_at, round(r.stop, 9)) for r in out.collect()}
    want = {}
    for _, day, side, sl, atr, since in held:
        sign = 1 if side == "buy" else -1
        best, stop = float("-inf"), sign * sl
        for _, at, _, high, low in rows:
            if at < since:
                continue
            best = max(best, high if sign > 0 else -low)
            stop = stop if atr is None else max(stop, best - 2 * atr)
            if (low if sign > 0 else -high) <= stop:
                want[f"S#{day}"] = (at, round(sign * stop, 9))
                break
    assert got == want and 2 < len(want) < len(held) + 1


def test_finished_days_leave_the_state(spark):
    """Forty days of fills, two batches a day: state holds the open days only, and a halt stays until local midnight."""
    rng = np.random.default_rng(2)
    rows = []
    for day in range(40):
        for hour in range(24):
            # From 19:00 UTC on it is the next trading day.
            rows.append((1 + hour, START + dt.timedelta(days=day, hours=hour), float(rng.normal(0, 40)), -0.5 if hour % 5 else None, None, hour))
    rows += [(0, START, 1e9, None, None, 0), (7, START + dt.timedelta(days=3, hours=1), -3000.0, None, None, 1), (8, START + dt.timedelta(days=3, hours=14), 2950.0, None, None, 14)]
    deals = spark.createDataFrame(rows, "position_id long, time timestamp_ntz, profit double, commission double, swap double, hour int")
    for c in ("profit", "commission", "swap"):
        deals = deals.withColumn(c, F.col(c).cast("decimal(18,4)"))
    deals = settle(deals)
    part = F.datediff(F.to_date("time"), F.lit("2024-01-01").cast("date")) * 2 + F.when(F.col("hour") >= 12, 1).otherwise(0)
    progress = []
    fills = J.replay(deals, "fills", part, 80).through(lambda df: J.stream_daily_loss(df, "6 hours"))
    out = {r.day: (round(r.net, 4), r.halt) for r in J.latched_days(J.drain(fills, "loss", mode="update", progress=progress), 10_000.0, 10.0).collect()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) <= 3, held
    want, worst = {}, {}
    for half in range(80):
        for pos, at, profit, commission, _, hour in rows:
            if pos and (at.date() - START.date()).days * 2 + (hour >= 12) == half:
                day = (at + dt.timedelta(hours=5)).date()
                want[day] = want.get(day, 0.0) + round(profit, 4) + (commission or 0.0)
        for day, net in want.items():
            worst[day] = min(worst.get(day, 0.0), net)
    assert set(out) == set(want)
    for day, (net, halt) in out.items():
        assert abs(net - want[day]) < 0.01 and halt == (worst[day] <= -1000)
    recovered = dt.date(2024, 1, 4)
    assert out[recovered][1] and out[recovered][0] > -1000


def test_reconcile_reads_only_what_a_batch_brings(spark):
    rows = [(p, START + dt.timedelta(hours=10 * k + p), k, k % 2, 100.0 + k, 1.0, "S", float(p - k), 777 if p == 3 and k == 2 else 0) for p in range(1, 6) for k in range(4)]
    deals = spark.createDataFrame(rows, "position_id long, time timestamp_ntz, deal_no int, type int, price double, volume double, symbol string, profit double, magic int")
    zero = F.lit(0).cast("decimal(18,4)")
    deals = settle(deals.withColumn("profit", F.col("profit").cast("decimal(18,4)")).withColumns({"commission": zero, "swap": zero, "part_id": F.lit(1), "venue": F.lit(1)}))
    twice = settle(deals.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))))
    target, progress = scratch_dir(spark, "parts"), []
    feed = J.replay(twice, "deals", F.least(F.col("deal_no") + F.col("again"), F.lit(3)), 4).through(lambda df: J.new_deals(df.drop("again"), "12 hours"))
    J.drain(feed, "reconcile", J.reconcile_batch(target, 777), progress=progress)
    known = spark.createDataFrame([(5,)], "ticket long")
    got = {r.ticket: (r.pnl, r.entry_price, r.exit_price) for r in J.reconciled(spark, target, known).collect()}
    assert got == {p: (float(4 * p - 6), 100.0, 103.0) for p in (1, 2, 4)}
    # Traces of deals leave the state as the watermark passes them.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) <= 15 and held[-1] < 20


def test_reconcile_state_lies_on_disk(spark, tables, monkeypatch):
    """Every deal leaves a trace, so they are kept on disk and not in the executors' heaps; later jobs keep their own settings."""
    from tidemark.plans import catalog

    key, progress, drain = "spark.sql.streaming.stateStore.providerClass", [], J.drain
    monkeypatch.setattr(J, "drain", lambda *a, **k: drain(*a, progress=progress, **k))
    before = spark.conf.get(key)
    got = catalog.QUERIES["stream_reconcile"](tables)
    states = [p["stateOperators"][0] for p in progress]
    assert sum(s["numRowsUpdated"] for s in states) == tables.deals().count() > 5000
    sizes = [s["customMetrics"].get("rocksdbSstFileSize", 0) for s in states]
    assert len(sizes) == 3 and 0 < sizes[0] < sizes[1] < sizes[2], sizes
    assert spark.conf.get(key) == before
    want = catalog.QUERIES["external_trades"](tables)
    key = lambda df: sorted((r.ticket, round(r.pnl, 4)) for r in df.select("ticket", F.col("pnl").cast("double").alias("pnl")).collect())
    assert key(got) == key(want) != []


def test_deals_are_told_apart_by_whole_rows_on_disk(spark):
    """A deal that comes again adds nothing; one that differs in a single column, or in what is unknown, is another deal."""
    base = (1, START, 1, 0, 100.0, 1.0, "S", 5.0, None, None, 7, 8, 0)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(names, base))
    names = "position_id time deal_no type price volume symbol profit commission swap part_id venue magic".split()
    deals = [base, change(commission=0.0), change(swap=0.0), change(part_id=None), change(venue=None), change(part_id=8, venue=7), change(time=START + dt.timedelta(microseconds=1))]
    schema = "position_id long, time timestamp_ntz, deal_no int, type int, price double, volume double, symbol string, profit double, commission double, swap double, part_id long, venue long, magic int"
    df = spark.createDataFrame(deals + deals, schema).withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("profit", "commission", "swap")})
    df = settle(df.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))))
    target = scratch_dir(spark, "parts")
    feed = J.replay(df, "deals", F.col("again"), 2).through(lambda d: J.new_deals(d.drop("again"), "12 hours"))
    J.drain(feed, "reconcile", J.reconcile_batch(target, 777), conf=J.DISK_STATE)
    got = J.reconciled(spark, target, spark.createDataFrame([], "ticket long")).collect()
    assert [(r.ticket, r.pnl) for r in got] == [(1, 5.0 * len(deals))]


def test_finished_tickets_stay_closed(spark):
    """A price that touches the stop again in a later batch brings no second row, though no earlier output is read."""
    bars = [("S", START + dt.timedelta(hours=i), i + 1, 100.0 + d, 99.0 + d) for i, d in enumerate([0, 1, -20, 0, 1, -30, 0, -40, 5])]
    positions = spark.createDataFrame([("S", 1, "buy", 90.0, None, START), ("S", 2, "buy", 75.0, None, START + dt.timedelta(hours=4))], "symbol string, day_no long, type string, sl double, atr_entry double, time timestamp")
    df = settle(spark.createDataFrame(bars, "symbol string, time timestamp, rn long, high double, low double"))
    held = J.replay(df, "prices", F.floor((F.col("rn") - 1) / 3), 3).through(lambda d: J.held_bars(d, positions))
    out = sorted((r.ticket, r.rn) for r in J.drain_keyed(held, "trailing", J.stream_trailing()).collect())
    assert out == [("S#1", 3), ("S#2", 6)]


def test_replay_takes_parts_in_order_and_refuses_other_rows(spark):
    df = settle(spark.range(90).repartition(6).withColumn("part", F.col("id") % 3))
    seen = []
    J.drain(J.replay(df, "ids", F.col("part"), 3), "order", lambda batch, i: seen.append((i, {r.part for r in batch.select("part").distinct().collect()}, batch.rdd.getNumPartitions() > 1)))
    assert seen == [(0, {0}, True), (1, {1}, True), (2, {2}, True)]
    with pytest.raises(ValueError):
        J.replay(df, "ids", F.col("part"), 2)
