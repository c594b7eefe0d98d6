"""Multiple-testing diagnostics of a parameter search, per symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import EULER_GAMMA, mix, norm_cdf, norm_ppf


def effective_trials(cands: DataFrame) -> DataFrame:
    """Product of the distinct values per parameter axis (MA pairs by ratio), at most the number of candidates."""
    g = cands.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_distinct(F.round(F.try_divide(F.col("ema_fast"), F.col("ema_slow")), 2)).alias("a"), F.count_distinct(F.round("sl", 3)).alias("b"),
        F.count_distinct(F.round("rr", 3)).alias("c"), F.count_distinct(F.floor("adx")).alias("d"), F.count_distinct(F.round("score", 3)).alias("e"),
    )
    product = F.col("a") * F.col("b") * F.col("c") * F.col("d") * F.col("e")
    return g.select("symbol", "n_trials", F.least(F.greatest(product, F.lit(1)), F.col("n_trials")).cast("double").alias("effective_trials"))


def expected_max_sharpe(n: Column, sr_std: Column) -> Column:
    """Expected best Sharpe of n skill-less trials with the given dispersion (Gumbel approximation)."""
    k = F.greatest(n, F.lit(2.0))
    best = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / k) + EULER_GAMMA * norm_ppf(1 - 1 / (k * math.e))
    return F.when(sr_std > 0, sr_std * best).otherwise(0.0)


def deflated_sharpe(df: DataFrame, sr: str, sr_std: str, n_trials: str, n_obs: str, skew: float = 0.0, kurtosis: float = 3.0) -> DataFrame:
    """Probability that the observed Sharpe beats the best of that many skill-less trials (column dsr)."""
    s = F.col(sr)
    denom = 1 - skew * s + (kurtosis - 1) / 4.0 * s * s
    z = (s - expected_max_sharpe(F.col(n_trials), F.col(sr_std))) * F.sqrt(F.col(n_obs) - 1) / F.sqrt(denom)
    return df.withColumn("__z", F.when((F.col(n_obs) >= 2) & (denom > 0), z)).withColumn("dsr", F.coalesce(norm_cdf("__z"), F.lit(0.0))).drop("__z")


def pbo(cands: DataFrame, is_col: str = "wf_score", oos_col: str = "oos_mean_pf", splits: int = 64, seed: int = 7) -> DataFrame:
    """Share of reproducible random halves whose in-sample winner ranks in the lower half out of sample; null below four.

    Halves are taken by a hash of (split, candidate); a symbol has one row per grid point.
    """
    ok = cands.where(F.col(is_col).isNotNull() & F.col(oos_col).isNotNull()).select("symbol", "param_id", F.col(is_col).alias("i"), F.col(oos_col).alias("o"))
    own = Window.partitionBy("symbol")
    ranked = ok.withColumns({"n": F.count(F.lit(1)).over(own), "below": F.rank().over(own.orderBy("o")) - 1}).where(F.col("n") >= 4)
    drawn = ranked.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    drawn = drawn.withColumn("h", mix(F.col("split"), F.col("param_id"), seed=seed))
    place = F.row_number().over(Window.partitionBy("symbol", "split").orderBy("h", "param_id"))
    half = drawn.withColumn("k", place).where(F.col("k") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    winner = half.groupBy("symbol", "split", "n").agg(F.max(F.struct("i", (-F.col("k")).alias("k"), "below")).alias("w"))
    g = winner.groupBy("symbol").agg(F.avg(F.when(F.col("w.below") / F.col("n") < 0.5, 1.0).otherwise(0.0)).alias("pbo"))
    return cands.select("symbol").distinct().join(g, "symbol", "left")


def overfit_summary(cands: DataFrame, score: str = "wf_score", oos: str = "oos_mean_pf") -> DataFrame:
    """All diagnostics of one search per symbol, rounded to four digits."""
    finite = cands.where(F.col(score).isNotNull() & (F.abs(score) != float("inf")))
    best = finite.groupBy("symbol").agg(
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sr_std"), F.max(score).alias("observed"), F.max_by("n_trades", score).alias("n_obs")
    )
    s = best.join(effective_trials(finite), "symbol").withColumn("n_obs", F.greatest(F.coalesce("n_obs", F.lit(2)), F.lit(2)))
    s = s.withColumn("expected_max_sr", expected_max_sharpe(F.col("effective_trials"), F.col("sr_std")))
    s = deflated_sharpe(s, "observed", "sr_std", "effective_trials", "n_obs").join(pbo(finite, score, oos), "symbol", "left")
    r4 = lambda c: F.round(c, 4).alias(c)
    return s.select("symbol", "n_trials", F.round("effective_trials", 2).alias("effective_trials"), r4("sr_std"), r4("expected_max_sr"), r4("dsr"), r4("pbo"))
