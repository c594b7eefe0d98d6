"""Correlation, drift, rank statistics and classification metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import TINY, correlation, norm_ppf, two_sided_p
from tidemark.functions.times import month_of
from tidemark.operators.chunks import index_rows, rolling
from tidemark.operators.joins import symbol_pairs
from tidemark.operators.orderstats import quantiles, with_average_rank
from tidemark.session import settle


def corr_matrix(bars: DataFrame, hours: int, min_rows: int = 5) -> DataFrame:
    """Pearson correlation of one-bar returns over the newest `hours`, using only times at which every symbol traded."""
    edge = bars.agg(F.max("time").alias("__end"), F.count_distinct("symbol").alias("__symbols"))
    since = F.col("__end") - F.expr(f"INTERVAL {hours} HOURS")
    dated = bars.select("symbol", "rn", "time", "close").crossJoin(F.broadcast(edge))  # one row
    before = dated.where(F.col("time") <= since).groupBy("symbol").agg(F.max("rn").alias("__from"))  # the row the first return starts from
    near = dated.join(before, "symbol", "left").where(F.col("rn") >= F.coalesce("__from", F.lit(0)))
    rets = rolling(near, lambda df, w: df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1), back=1)
    recent = rets.where(F.col("ret").isNotNull() & (F.col("time") > since)).drop("__from")
    full = recent.groupBy("time", "__symbols").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == F.col("__symbols"))
    pairs = symbol_pairs(recent.join(full.select("time"), "time"))
    out = pairs.groupBy("s1", "s2").agg(correlation("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_rows)


def corr_reduction(corr: DataFrame, held: DataFrame, max_reduction: float = 0.5) -> DataFrame:
    """Size factor per symbol from its largest correlation with another held symbol."""
    both = corr.select(F.col("s1").alias("symbol"), F.col("s2").alias("other"), "corr").unionByName(
        corr.select(F.col("s2").alias("symbol"), F.col("s1").alias("other"), "corr")
    )
    usable = F.when(F.col("corr").isNull() | F.isnan("corr"), 0.0).otherwise(F.col("corr"))
    top = both.join(held.select(F.col("symbol").alias("other")), "other").groupBy("symbol").agg(F.max(usable).alias("c"))
    c = F.greatest("c", F.lit(0.0))
    factor = F.when(c <= 0.5, 1.0).otherwise(F.greatest(1 - (c - 0.5) / 0.5 * max_reduction, F.lit(1 - max_reduction)))
    return top.select("symbol", c.alias("max_corr"), factor.alias("reduction"))


def adx_percentiles(bars: DataFrame, days: int = 180, col: str = "adx", min_rows: int = 50) -> DataFrame:
    """Median and 70th percentile of the ADX over the trailing days of each symbol."""
    edge = bars.groupBy("symbol").agg(F.max("time").alias("__end"))
    recent = bars.join(edge, "symbol").where(F.col("time") > F.col("__end") - F.expr(f"INTERVAL {days} DAYS"))
    q = quantiles(recent, ["symbol"], col, {"p50": 0.5, "p70": 0.7})
    return q.where(F.col("n_rows") >= min_rows).drop("n_rows")


def feature_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("symbol",), min_rows: int = 10) -> DataFrame:
    """Mean and sample deviation per feature having more than `min_rows` values."""
    long = df.select(*by, *[F.col(c).cast("double") for c in features]).unpivot(list(by), list(features), "feature", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    g = long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") > min_rows)


def _psi_sum(expected: Column, actual: Column) -> Column:
    e, a = F.greatest(expected, F.lit(TINY)), F.greatest(actual, F.lit(TINY))
    return (a - e) * F.log(a / e)


def psi(expected: DataFrame, actual: DataFrame, by: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Population stability index of `actual` over the decile bins of `expected` (outer bins open, left-closed).

    0 with fewer than ten values on a side or without spread.
    """
    by = list(by)
    e = expected.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value, F.lit(1).alias("__e"))
    a = actual.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value, F.lit(0).alias("__e"))
    edges = quantiles(e, by, value, {f"q{i}": i / bins for i in range(1, bins)})
    edges = edges.select(*by, F.array(*[f"q{i}" for i in range(1, bins)]).alias("__edges"))
    bin_no = F.size(F.filter("__edges", lambda x: x <= F.col(value)))
    rows = e.unionByName(a).join(edges, by).withColumn("bin", bin_no)
    counts = rows.groupBy(*by, "bin").agg(F.sum("__e").alias("ne"), F.sum(1 - F.col("__e")).alias("na"))
    whole = e.unionByName(a).groupBy(*by).agg(
        F.sum("__e").alias("te"), F.sum(1 - F.col("__e")).alias("ta"), F.stddev_pop(value).alias("__sd")
    )
    grid = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, by + ["bin"], "left")
    share = lambda n, t: F.coalesce(F.col(n), F.lit(0)) / F.col(t)
    ok = (F.col("te") >= 10) & (F.col("ta") >= 10) & (F.col("__sd") >= TINY)
    return full.groupBy(*by).agg(F.sum(F.when(ok, _psi_sum(share("ne", "te"), share("na", "ta"))).otherwise(0.0)).alias("psi"))


def psi_drift(
    live: DataFrame, stats: DataFrame, features: Sequence[str], last: int = 200, min_rows: int = 50, limit: float = 0.2, bins: int = 10
) -> DataFrame:
    """Features whose newest values drifted from N(mean, std), and whether a symbol has at least three.

    The training side is the normal distribution itself: each decile bin has probability 1/bins and analytic edges.
    `live` carries row numbers per symbol.
    """
    long = live.select("symbol", "rn", *[F.col(c).cast("double") for c in features]).unpivot(["symbol", "rn"], list(features), "feature", "value")
    known = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # The newest values: rows within the last `last` known ones, found from the symbol's end without sorting it whole.
    newest = _newest(known, ["symbol", "feature"], last)
    probs = [i / bins for i in range(1, bins)]
    z = (F.col("value") - F.col("mean")) / F.col("std")
    edges = F.array(*[norm_ppf(F.lit(p)) for p in probs])
    bin_no = F.size(F.filter(edges, lambda x: x <= F.col("__z")))
    rows = newest.join(stats.where(F.col("std") > 0).select("symbol", "feature", "mean", "std"), ["symbol", "feature"]).withColumn("__z", z)
    counts = rows.withColumn("bin", bin_no).groupBy("symbol", "feature", "bin").agg(F.count(F.lit(1)).alias("na"))
    whole = rows.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("ta"), F.stddev_pop("value").alias("sd")).where(F.col("ta") >= min_rows)
    full = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["symbol", "feature", "bin"], "left")
    value = F.sum(_psi_sum(F.lit(1.0 / bins), F.coalesce("na", F.lit(0)) / F.col("ta")))
    per = full.groupBy("symbol", "feature").agg(value.alias("psi"))
    flags = per.groupBy("symbol").agg(F.count_if(F.col("psi") > limit).alias("n_drifted"), F.max("psi").alias("max_psi"))
    return per.join(flags, "symbol").withColumn("drift", F.col("n_drifted") >= 3)


def _newest(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    from tidemark.operators.ranking import top_k_per

    return top_k_per(df, list(by), [F.desc("rn")], n).drop("rank")


def z_drift(live: DataFrame, stats: DataFrame, features: Sequence[str], limit: float = 2.0) -> DataFrame:
    """Features of each symbol's latest row more than `limit` deviations away; drift from three on."""
    latest = live.groupBy("symbol").agg(F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in features]), "rn").alias("r")).select("symbol", "r.*")
    long = latest.unpivot("symbol", list(features), "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    rows = long.join(stats.where(F.col("std") > 0), ["symbol", "feature"]).withColumn("z", z)
    return rows.groupBy("symbol").agg(F.count_if(F.col("z") > limit).alias("n_drifted"), F.max("z").alias("max_z")).withColumn("drift", F.col("n_drifted") >= 3)


def confidence_drift(conf: DataFrame, value: str = "conf", head: int = 50, drop: float = 0.15) -> DataFrame:
    """Mean of the first `head` confidences against the mean of the newest `head` (numbered rows per symbol)."""
    n = conf.groupBy("symbol").agg(F.max("rn").alias("__n"))
    c = conf.join(n, "symbol")
    agg = c.groupBy("symbol").agg(
        F.avg(F.when(F.col("rn") <= head, F.col(value))).alias("baseline"), F.avg(F.when(F.col("rn") > F.col("__n") - head, F.col(value))).alias("recent"), F.max("__n").alias("n")
    )
    ratio = F.when(F.col("baseline") > 0, 1 - F.col("recent") / F.col("baseline"))
    return agg.where(F.col("n") >= head).select("symbol", "baseline", "recent", ratio.alias("drop_ratio"), F.coalesce(ratio > drop, F.lit(False)).alias("drift"))


def _long(df: DataFrame, components: Sequence[str], fwd: str, keys: Sequence[str]) -> DataFrame:
    known = df.where(F.col(fwd).isNotNull()).select(*keys, fwd, *[F.col(c).cast("double") for c in components])
    return known.unpivot([*keys, fwd], list(components), "component", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def rank_ic(df: DataFrame, components: Sequence[str], fwd: str = "fwd_24", min_rows: int = 50) -> DataFrame:
    """Spearman correlation of each component with the forward return, and its p-value."""
    long = _long(df, components, fwd, [])
    ranked = with_average_rank(with_average_rank(long, ["component"], "value", "rx"), ["component"], fwd, "ry")
    g = ranked.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), correlation("rx", "ry").alias("__ic")
    ).where(F.col("n") >= min_rows)
    ic = F.coalesce(F.when(~F.isnan("__ic"), F.col("__ic")), F.lit(0.0))
    return g.withColumn("ic", ic).withColumn("p_value", two_sided_p("ic", F.col("n").cast("double"))).drop("__ic")


def rank_auc(df: DataFrame, components: Sequence[str], fwd: str = "fwd_24") -> DataFrame:
    """Area under the ROC curve of each component against a positive forward return (0.5 with one class only)."""
    long = _long(df, components, fwd, [])
    ranked = with_average_rank(long, ["component"], "value", "rx")
    pos = F.col(fwd) > 0
    g = ranked.groupBy("component").agg(F.sum(F.when(pos, F.col("rx"))).alias("s"), F.count_if(pos).alias("np"), F.count_if(~pos).alias("nn"))
    auc = (F.col("s") - F.col("np") * (F.col("np") + 1) / 2.0) / (F.col("np") * F.col("nn"))
    return g.select("component", F.when((F.col("np") > 0) & (F.col("nn") > 0), auc).otherwise(0.5).alias("auc"), (F.col("np") / (F.col("np") + F.col("nn"))).alias("win_rate"))


def quartile_spread(df: DataFrame, components: Sequence[str], fwd: str = "fwd_24") -> DataFrame:
    """Mean forward return of each component's lowest and highest quartile and their difference.

    Quartile edges are right-closed; where edges coincide, quartiles of first-come ranks (time, symbol) are used.
    """
    long = settle(_long(df, components, fwd, ["time", "symbol"]))
    q = quantiles(long, ["component"], "value", {"e0": 0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1})
    strict = (F.col("e0") < F.col("e1")) & (F.col("e1") < F.col("e2")) & (F.col("e2") < F.col("e3")) & (F.col("e3") < F.col("e4"))
    q = q.withColumn("by_value", strict)
    from tidemark.operators.orderstats import rank_table

    ties = index_rows(long, ["component", "value"], [month_of("time")], ["time", "symbol"], "__tie")
    ranks = rank_table(long, ["component"], "value").select("component", "value", "below")
    rows = ties.join(ranks, ["component", "value"]).join(F.broadcast(q), "component")
    first_rank = F.col("below") + F.col("__tie")
    at = lambda p: 1 + (F.col("n_rows") - 1) * p
    quart = lambda x, a, b, c: F.when(x <= a, 1).when(x <= b, 2).when(x <= c, 3).otherwise(4)
    bucket = F.when(F.col("by_value"), quart(F.col("value"), F.col("e1"), F.col("e2"), F.col("e3"))).otherwise(
        quart(first_rank, at(0.25), at(0.5), at(0.75))
    )
    g = rows.withColumn("q", bucket).groupBy("component").agg(
        F.avg(F.when(F.col("q") == 1, F.col(fwd))).alias("q1_ret"), F.avg(F.when(F.col("q") == 4, F.col(fwd))).alias("q4_ret")
    )
    return g.withColumn("spread_q4_q1", F.col("q4_ret") - F.col("q1_ret"))


def quartile_winrate(df: DataFrame, composite: str, fwd: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of positive forward returns among the top and bottom quarter of a composite."""
    by = list(by)
    known = df.where(F.col(fwd).isNotNull() & F.col(composite).isNotNull())
    q = quantiles(known, by, composite, {"lo": 0.25, "hi": 0.75})
    rows = known.join(q, by) if by else known.crossJoin(F.broadcast(q))
    win = F.when(F.col(fwd) > 0, 1.0).otherwise(0.0)
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(
        F.avg(F.when(F.col(composite) >= F.col("hi"), win)).alias("top_win_rate"), F.avg(F.when(F.col(composite) <= F.col("lo"), win)).alias("bot_win_rate")
    )


def percentile_of_score(df: DataFrame, value: str, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """Percent of values at or below `score` (50 for an empty group)."""
    share = F.avg(F.when(F.col(value) <= score, 100.0).otherwise(0.0))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.coalesce(share, F.lit(50.0)).alias("percentile_rank"))


def binary_metrics(pred: DataFrame, label: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy of 0/1 predictions per key; mean absolute error."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    g = pred.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.avg(F.abs(F.col(label) - F.col(predicted))).alias("mae"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return g.withColumn("f1", f1).withColumn("accuracy", acc)
