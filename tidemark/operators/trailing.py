"""Trailing stops of positions that may stay open for any number of bars.

A position never carries all its bars. Its extreme between two rows comes from a constant number of equality joins on
block tables (``extreme_between``); its exit is searched in rounds of growing spans, each of which hands on one row of state
for the positions still open (``trail``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY
from tidemark.operators.joins import asof_join
from tidemark.session import settle

#: Rows of a block, and the most rows of a position that one round looks at.
BLOCK, SPAN = 256, 16_384


def _long() -> Column:
    return F.col("type") == "buy"


def _side() -> Column:
    return F.when(_long(), 1.0).otherwise(-1.0)


def acceleration(ratio: Column, strength: float = 0.2) -> Column:
    """Factor from the ratio of a moving average to its earlier value: tighter while it rises, wider while it falls, between
    0.5 and 1.5; 1 where the ratio is unknown."""
    up = 1.0 - strength * F.least(ratio - 1.0, F.lit(1.0))
    down = 1.0 + strength * F.least(1.0 - ratio, F.lit(1.0))
    return F.when(ratio.isNull(), 1.0).otherwise(F.greatest(F.least(F.when(ratio > 1.0, up).otherwise(down), F.lit(1.5)), F.lit(0.5)))


def acceleration_live(ratio: Column, strength: float = 0.2, least: float = 0.01) -> Column:
    """The form used on running positions (column type): mirrored for shorts, within 1 -+ strength, changes of `least` and
    less ignored."""
    turn = F.greatest(F.least(F.when(_long(), 2.0 - ratio).otherwise(ratio), F.lit(1.0 + strength)), F.lit(1.0 - strength))
    return F.when(ratio.isNotNull() & (F.abs(turn - 1.0) > least), turn).otherwise(1.0)


def stop_mult(close: Column, partial: Column, accel: Column | None = None, loose: float = 3.5, tight: float = 1.5, after_partial: float = 1.5, min_r: float = 3.0) -> Column:
    """ATR multiple of the stop: `tight` once the open profit reaches `min_r` initial risks, else `loose`; `after_partial`
    once a part of the position is closed, whatever the profit; times the acceleration factor."""
    risk = F.greatest(F.abs(F.col("price_open") - F.col("sl")), F.lit(TINY))
    staged = F.when((close - F.col("price_open")) * _side() / risk >= min_r, tight).otherwise(loose)
    mult = F.when(partial, after_partial).otherwise(staged)
    return mult if accel is None else mult * accel


def partial_level(target: Column | float, rr: float = 2.0) -> Column:
    """Price at which the first part is closed: the share `target` of the way to the profit target."""
    return F.col("price_open") + _side() * F.abs(F.col("price_open") - F.col("sl")) * rr * target


def with_start(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds start_rn, the last bar strictly before the entry (the symbol's first one, if there is none), and end_rn, the
    last bar. Positions of symbols without bars go."""
    ahead = positions.withColumn("__ahead", F.col("time") - F.expr("INTERVAL 1 MICROSECOND"))
    p = asof_join(ahead, bars.select("symbol", F.col("time").alias("__at"), F.col("rn").alias("start_rn")), ["start_rn"], on="__ahead", right_on="__at").drop("__ahead")
    ends = bars.groupBy("symbol").agg(F.min("rn").alias("__first"), F.max("rn").alias("end_rn"))
    return p.join(ends, "symbol").withColumn("start_rn", F.coalesce("start_rn", "__first")).drop("__first")


def _block(c: Column, block: int) -> Column:
    return F.floor(c / block).cast("long")


def extreme_between(asked: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds highest and lowest: over the bars of `symbol` from row `from_rn` to row `to_rn` (null if there are none).

    Each bar knows the extremes of its block up to and from its own row; blocks know those of 1, 2, 4, ... blocks from
    them on. An interval is the rest of its first block, the beginning of its last one and two overlapping runs of whole
    blocks between them: four equality joins whatever its length. Only an interval inside one block meets its rows.
    """
    bars = bars.select("symbol", F.col("rn").cast("long").alias("rn"), "high", "low").withColumn("__b", _block(F.col("rn"), block))
    w = Window.partitionBy("symbol", "__b").orderBy("rn")
    upto, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    edge = settle(bars.select(
        "symbol", "rn", F.max("high").over(upto).alias("__up_h"), F.min("low").over(upto).alias("__up_l"), F.max("high").over(onward).alias("__on_h"), F.min("low").over(onward).alias("__on_l"),
    ))
    blocks = bars.groupBy("symbol", "__b").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    most = blocks.groupBy("symbol").agg((F.max("__b") - F.min("__b")).alias("n")).agg(F.max("n")).first()[0] or 0
    level = lambda k: Window.partitionBy("symbol").orderBy("__b").rangeBetween(0, (1 << k) - 1)
    levels = range(max(1, int(most).bit_length()))
    wide = blocks.select("symbol", "__b", *[F.struct(F.lit(k).alias("k"), F.max("h").over(level(k)).alias("h"), F.min("l").over(level(k)).alias("l")).alias(f"r{k}") for k in levels])
    table = settle(wide.select("symbol", "__b", F.explode(F.array(*[f"r{k}" for k in levels])).alias("r")).select("symbol", "__b", "r.*"))

    q = asked.withColumns({"__first": _block(F.col("from_rn"), block), "__last": _block(F.col("to_rn"), block)})
    gap = F.col("__last") - F.col("__first") - 1
    k = F.when(gap > 0, F.floor(F.log2(gap.cast("double") + 0.5))).cast("int")
    q = q.withColumn("__k", k).withColumn("__second", F.when(gap > 0, F.col("__last") - F.expr("shiftleft(1L, __k)")))
    wide = F.col("__last") > F.col("__first")
    head = edge.select("symbol", F.col("rn").alias("from_rn"), F.col("__on_h").alias("h1"), F.col("__on_l").alias("l1"))
    tail = edge.select("symbol", F.col("rn").alias("to_rn"), F.col("__up_h").alias("h2"), F.col("__up_l").alias("l2"))
    run = lambda at, n: table.select("symbol", (F.col("__b") - at).alias("__first" if at else "__second"), F.col("k").alias("__k"), F.col("h").alias(f"h{n}"), F.col("l").alias(f"l{n}"))
    far = q.where(wide).join(head, ["symbol", "from_rn"], "left").join(tail, ["symbol", "to_rn"], "left")
    far = far.join(run(1, 3), ["symbol", "__first", "__k"], "left").join(run(0, 4), ["symbol", "__second", "__k"], "left")
    far = far.select(*asked.columns, F.greatest("h1", "h2", "h3", "h4").alias("highest"), F.least("l1", "l2", "l3", "l4").alias("lowest"))
    near = q.where(~wide).withColumn("__id", F.monotonically_increasing_id())
    near = settle(near)  # the numbers must not change when a task runs again
    inside = near.select("__id", "symbol", F.col("__first").alias("__b"), "from_rn", "to_rn").join(bars, ["symbol", "__b"]).where((F.col("rn") >= F.col("from_rn")) & (F.col("rn") <= F.col("to_rn")))
    found = inside.groupBy("__id").agg(F.max("high").alias("highest"), F.min("low").alias("lowest"))
    return far.unionByName(near.join(found, "__id", "left").select(*asked.columns, "highest", "lowest"))


def trail(positions: DataFrame, bars: DataFrame, mult: Column, keys: Sequence[str], level: Column | None = None, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """First bar at which each position's trailing stop is reached.

    `positions` have keys, symbol, type, price_open, sl, time (entry), start_rn, end_rn (``with_start``); `bars` symbol, rn (without
    gaps), time, high, low, close, atr and whatever `mult` names. The stop is the extreme since start_rn less ATR times `mult`,
    never loosened and never beyond sl; `mult` may name position and bar columns and ``partial``, which tells whether a bar
    after the entry has reached `level`. Adds exit_rn, exit_time, exit_stop (null while open), partial_time (null if the level is not
    reached before the exit), last_time, last_close and extreme, stop at the last bar looked at.

    A round looks at the next bars of each open position, four times as many as the round before up to `span`, and hands on
    extreme and stop. So the rows read follow the time positions are open, not the length of the series, and a window
    holds at most `span` bars of one position.
    """
    own = list(dict.fromkeys([*keys, *positions.columns]))
    at = Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    b = bars.select("symbol", F.col("rn").alias("__rn"), *[F.col(c).alias(f"__{c}") for c in bars.columns if c not in ("symbol", "rn")]).withColumn("__block", _block(F.col("__rn"), block))
    reach = level if level is not None else F.lit(None).cast("double")
    state = settle(positions.select(*own, F.col("start_rn").cast("long").alias("next"), *[F.lit(None).cast(t).alias(c) for c, t in (("extreme", "double"), ("stop", "double"), ("partial_time", "timestamp_ntz"))]))
    done, size = None, block
    while not state.isEmpty():
        until = F.least(F.col("next") + size - 1, F.col("end_rn"))
        spread = state.withColumn("__until", until).withColumn("__block", F.explode(F.sequence(_block(F.col("next"), block), _block(until, block))))
        rows = spread.join(b, ["symbol", "__block"]).where((F.col("__rn") >= F.col("next")) & (F.col("__rn") <= F.col("__until"))).drop("__block")
        bar = [F.col(f"__{c}").alias(c if c not in own else f"__{c}") for c in bars.columns if c not in ("symbol", "rn")]
        rows = rows.select(*own, "next", F.col("extreme").alias("__ext"), F.col("stop").alias("__stop"), F.col("partial_time").alias("__part"), F.col("__rn").alias("rn"), *bar)
        when = "__time" if "time" in own else "time"
        after = F.col(when) > F.col("time") if when == "__time" else F.lit(True)
        hit = after & F.coalesce(F.when(_long(), F.col("high") >= reach).otherwise(F.col("low") <= reach), F.lit(False))
        rows = rows.withColumn("__level_at", F.coalesce("__part", F.min(F.when(hit, F.col(when))).over(at)))
        rows = rows.withColumn("partial", F.col("__level_at").isNotNull())
        # In terms of a long position: a short one is turned over.
        rows = rows.withColumn("__peak", F.greatest(F.col("__ext") * _side(), F.max(F.when(_long(), F.col("high")).otherwise(-F.col("low"))).over(at)))
        rows = rows.withColumn("__raw", F.col("__peak") - F.col("atr") * mult)
        rows = rows.withColumn("__line", F.greatest(F.col("__stop") * _side(), F.max("__raw").over(at), F.col("sl") * _side()))
        touched = after & (F.when(_long(), F.col("low")).otherwise(-F.col("high")) <= F.col("__line"))
        last = F.max_by(F.struct(F.col("rn").alias("rn"), F.col(when).alias("time"), F.col("close").alias("close"), F.col("__peak").alias("peak"), F.col("__line").alias("line"), F.col("__level_at").alias("level_at")), F.col("rn"))
        exit_at = F.min(F.when(touched, F.struct(F.col("rn").alias("rn"), F.col(when).alias("time"), F.col("__line").alias("line"), F.col("__peak").alias("peak"), F.col("close").alias("close"), F.col("__level_at").alias("level_at"))))
        g = settle(rows.groupBy(*own).agg(exit_at.alias("x"), last.alias("e")))
        out = F.coalesce(F.col("x.rn"), F.col("e.rn"))
        ended = F.col("x").isNotNull() | (F.col("e.rn") >= F.col("end_rn"))
        pick = lambda c: F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"e.{c}"))
        # A level first reached on the exit bar itself comes too late.
        early = F.when(F.col("x").isNull() | (pick("level_at") < F.col("x.time")), pick("level_at"))
        part = g.where(ended).select(
            *own, F.col("x.rn").alias("exit_rn"), F.col("x.time").alias("exit_time"), (F.col("x.line") * _side()).alias("exit_stop"), early.alias("partial_time"),
            pick("time").alias("last_time"), pick("close").alias("last_close"), (pick("peak") * _side()).alias("extreme"), (pick("line") * _side()).alias("stop"), out.alias("last_rn"),
        )
        done = part if done is None else done.unionByName(part)
        state = settle(g.where(~ended).select(*own, (F.col("e.rn") + 1).alias("next"), (F.col("e.peak") * _side()).alias("extreme"), (F.col("e.line") * _side()).alias("stop"), F.col("e.level_at").alias("partial_time")))
        size = min(span, size * 4)
    if done is None:
        kinds = "exit_rn bigint, exit_time timestamp_ntz, exit_stop double, partial_time timestamp_ntz, last_time timestamp_ntz, last_close double, extreme double, stop double, last_rn bigint"
        done = positions.limit(0).select(*own, *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
    return done
