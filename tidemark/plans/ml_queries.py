"""Model training, validation and scoring."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import ml as M
from tidemark.operators import projections as P
from tidemark.operators import trees as K
from tidemark.operators import windows as N
from tidemark.plans.flow_queries import rounded
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import LABEL, atr_bars
from tidemark.plans.stat_queries import featured
from tidemark.plans.views import Tables, sql
from tidemark.session import settle

FEATURES = ["ret_1", "ret_5", "vol_ratio", "volatility_20", "volume_rank_20", "close_position", "body_ratio", "hour_sin", "hour_cos"]
TREES = {"trees": 6, "depth": 3, "rate": 0.2, "bins": 16}
TINY = {"trees": 4, "depth": 2, "rate": 0.2, "seed": 42}


def training_rows(t: Tables):
    """A small feature set with directional labels and R multiples."""
    b = L.r_multiple(L.triple_barrier(atr_bars(t)))
    b = N.volume_rank(N.rolling_vol(N.rel_volume(N.returns(b, (1, 5)))))
    b = P.time_features(P.candle_shape(b)).where(F.col("label").isNotNull() & (F.col("rn") > 21))
    return settle(b.select("symbol", "time", "rn", *FEATURES, F.when(F.col("label") == 1, 1).otherwise(0).alias("label"), "r_multiple"))


def between(rows, start: float, end: float, gap: int = 0, pos: str = "rn"):
    """Rows of each symbol whose position lies between two shares of its last one, without the first `gap` rows."""
    size = rows.groupBy("symbol").agg(F.max(pos).alias("__n"))
    n = F.col("__n")
    return rows.join(size, "symbol").where((F.col(pos) > F.floor(n * start) + gap) & (F.col(pos) <= F.floor(n * end))).drop("__n")


@query(
    "purged_splits",
    sql(
        """SELECT symbol, rn, CAST(k AS INTEGER) AS fold, CASE WHEN rn - 1 < greatest((k + 1) * fs - 12, 0) THEN 'train' ELSE 'test' END AS role FROM (SELECT symbol, rn, count(*) OVER (PARTITION BY symbol) AS n, count(*) OVER (PARTITION BY symbol) // 6 AS fs FROM bars), range(5) r(k)
WHERE rn - 1 < greatest((k + 1) * fs - 12, 0) OR (rn - 1 >= (k + 1) * fs AND rn - 1 < CASE WHEN k < 4 THEN (k + 2) * fs ELSE n END)"""
    ),
)
def _(t: Tables):
    return M.purged_splits(t.bars().select("symbol", "rn"))


PRED_SQL = "SELECT symbol, rn, round(least(greatest(close / 100, 0.02), 0.98), 4) AS prob, CASE WHEN close > open THEN 1 ELSE 0 END AS label FROM bars"


def proxy_predictions(t: Tables):
    """Predictions as any model would deliver them: a probability and the outcome per bar."""
    p = F.round(F.least(F.greatest(F.col("close") / 100, F.lit(0.02)), F.lit(0.98)), 4)
    return t.bars().select("symbol", "rn", p.alias("prob"), F.when(F.col("close") > F.col("open"), 1).otherwise(0).alias("label"))


@query(
    "best_threshold",
    sql(
        """SELECT symbol, th AS threshold, ev, trades FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ev DESC, th) AS k FROM (SELECT symbol, t / 100 AS th, CAST(count(*) FILTER (label = 1) * 2.0 - count(*) FILTER (label = 0) AS DOUBLE) AS ev, count(*) AS trades
FROM pr JOIN (SELECT unnest(range(30, 86)) AS t) ON prob * 100 + 1e-9 >= t GROUP BY 1, 2 HAVING count(*) >= 60)) WHERE k = 1""",
        pr=PRED_SQL,
    ),
)
def _(t: Tables):
    return M.best_threshold(proxy_predictions(t), by=["symbol"])


@query(
    "prune_features",
    sql("SELECT feature, importance, CAST(rank AS INTEGER) AS rank FROM (SELECT p_name AS feature, round(avg(p_size), 6) AS importance, row_number() OVER (ORDER BY round(avg(p_size), 6) DESC, p_name) AS rank, count(*) OVER () AS n FROM part GROUP BY 1) WHERE rank <= greatest(1, floor(n * 0.7 + 1e-9))"),
)
def _(t: Tables):
    return M.prune_features(t.read("part").groupBy(F.col("p_name").alias("feature")).agg(F.round(F.avg("p_size"), 6).alias("importance")))


@query(
    "ml_multipliers",
    sql(
        """SELECT symbol, rn, tu AS threshold_used, round(CASE WHEN prob >= tu THEN least(greatest(prob / tu, 0.5), 2) ELSE 0 END, 6) AS ml_mult_buy, round(CASE WHEN 1 - prob >= tu THEN least(greatest((1 - prob) / tu, 0.5), 2) ELSE 0 END, 6) AS ml_mult_sell
FROM (SELECT *, CASE WHEN avg(CASE WHEN prob >= th THEN 1.0 ELSE 0 END) OVER (PARTITION BY symbol) < 0.001 THEN 0.55::DOUBLE ELSE th END AS tu FROM (SELECT *, CASE WHEN symbol = 'click' THEN 0.99::DOUBLE ELSE 0.6::DOUBLE END AS th FROM pr))""",
        pr=PRED_SQL,
    ),
)
def _(t: Tables):
    out = M.ml_multipliers(proxy_predictions(t), F.when(F.col("symbol") == "click", 0.99).otherwise(0.6))
    return rounded(out.select("symbol", "rn", "threshold_used", "ml_mult_buy", "ml_mult_sell"))


@query(
    "ml_gate",
    sql(
        """SELECT symbol, rn, NOT has OR (ok AND NOT veto) AS ml_pass, round(CASE WHEN has THEN CASE WHEN ok AND veto THEN conf * meta ELSE conf END END, 6) AS ml_conf, CASE WHEN symbol IN ('click', 'view') THEN 'symbol' WHEN symbol = 'error' THEN 'pool' ELSE 'none' END AS model_used FROM (
SELECT *, symbol IN ('click', 'view', 'error') AS has, conf >= CASE WHEN th = opt AND conf < th AND conf >= 0.55 THEN 0.55 ELSE th END AS ok, coalesce(meta < 0.5, false) AS veto FROM (
SELECT *, CASE WHEN symbol = 'view' THEN 0.4::DOUBLE ELSE coalesce(opt, 0.55::DOUBLE) END AS th FROM (SELECT symbol, rn, CASE WHEN label = 1 THEN prob ELSE 1 - prob END AS conf, CASE WHEN rn % 3 = 0 THEN prob END AS meta,
CASE symbol WHEN 'click' THEN 0.7::DOUBLE WHEN 'view' THEN 0.6::DOUBLE WHEN 'error' THEN 0.65::DOUBLE END AS opt FROM pr)))""",
        pr=PRED_SQL,
    ),
)
def _(t: Tables):
    p = proxy_predictions(t).withColumns({
        "signal": F.when(F.col("label") == 1, "buy").otherwise("sell"), "asset_class": F.when(F.col("symbol") == "error", "crypto").otherwise("forex"),
        "meta_prob": F.when(F.col("rn") % 3 == 0, F.col("prob")),
    })
    models = t.spark.createDataFrame([("click", None, 0.7), ("view", 0.4, 0.6)], "symbol string, override double, optimal double")
    pools = t.spark.createDataFrame([("crypto", 0.65)], "asset_class string, optimal double")
    return rounded(M.ml_gate(p, models, pools).select("symbol", "rn", "ml_pass", "ml_conf", "model_used"))


@query("train_ensemble")
def _(t: Tables):
    rows = training_rows(t)
    return rounded(M.train_ensemble(between(rows, 0, 0.75), FEATURES, p=TINY).probabilities(between(rows, 0.75, 1, 20)).select("symbol", "rn", "label", "prob"))


@query("train_fold_calibrated")
def _(t: Tables):
    rows = settle(M.number_rows(training_rows(t).withColumnRenamed("rn", "bar")))
    split = M.purged_splits(rows, 3, 20, by=(), pos="pos")
    return rounded(M.train_fold(split, 2, FEATURES, "pos", TINY)[1].select("symbol", "pos", "label", "prob"))


@query("train_regressor")
def _(t: Tables):
    rows = training_rows(t)
    pred = M.train_regressor(between(rows, 0, 0.75), between(rows, 0.75, 1, 20), FEATURES, p=TINY)
    return rounded(pred.groupBy("symbol").agg(F.avg(F.abs(F.col("expected_r") - F.col("r_multiple"))).alias("mae"), F.count(F.lit(1)).alias("n")))


@query("calibration_curve")
def _(t: Tables):
    """Isotonic calibration on a holdout: mean calibrated probability and hit rate per tenth."""
    rows = training_rows(t)
    m = M.train_ensemble(between(rows, 0, 0.6), FEATURES, p=TINY)
    c = M.calibrate(m, between(rows, 0.6, 0.82)).probabilities(between(rows, 0.82, 1, 20))
    return rounded(c.groupBy(F.floor(F.col("prob") * 10).alias("tenth")).agg(F.avg("prob").alias("prob"), F.avg("label").alias("hit_rate"), F.count(F.lit(1)).alias("n")))


@query("meta_labeler")
def _(t: Tables):
    rows = settle(M.number_rows(training_rows(t).withColumnRenamed("rn", "bar")))
    m = M.train_ensemble(between(rows, 0, 0.45, pos="bar"), FEATURES, p=TINY)
    return rounded(M.train_meta(m.probabilities(rows), FEATURES, p=TINY)[1].select("symbol", "pos", "label", "meta_prob"))


@query("pool_model")
def _(t: Tables):
    classes = {"click": "crypto", "view": "crypto", "error": "forex"}
    return rounded(M.train_pool(training_rows(t), FEATURES, "crypto", classes, TINY)[1])


@query("symbol_training_runs")
def _(t: Tables):
    """Out-of-fold results of every symbol, all models grown together."""
    return rounded(M.train_symbols(training_rows(t), FEATURES, folds=2, p=TREES))


@query("symbol_importances")
def _(t: Tables):
    """Share of every feature in each symbol's total gain, ranked."""
    models = K.fit(training_rows(t), ["symbol"], FEATURES, p=TREES)
    r = rounded(K.importances(models, ["symbol"], FEATURES))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature")))  # one row per feature


@query("hyper_parameter_search")
def _(t: Tables):
    rows = settle(M.number_rows(training_rows(t).withColumnRenamed("rn", "bar")))
    grid = [TINY, {**TINY, "depth": 3}]
    return rounded(M.tune(rows, FEATURES, grid, folds=2))


@query("drift_retrain")
def _(t: Tables):
    from tidemark.operators.stats import confidence_drift

    conf = featured(t).withColumn("conf", F.least(F.col("close") / 100, F.lit(1.0)))
    drift = confidence_drift(conf, drop=0.0)  # any fall of the mean refits
    return rounded(M.retrain(training_rows(t), drift, FEATURES, p=TREES))
