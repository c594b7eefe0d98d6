"""Model training, calibration and scoring on Spark ML.

Rows are (symbol, time, rn, feature columns, label 0/1). Folds, calibration tails and thresholds are tables; one
Spark fit per member and fold, its input distributed like any other DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import month_of
from tidemark.operators import trees
from tidemark.operators.chunks import index_rows
from tidemark.operators.ranking import top_k_per
from tidemark.operators.stats import binary_metrics
from tidemark.session import settle

SMALL = {"trees": 10, "depth": 3, "rate": 0.1, "seed": 42}


def number_rows(df: DataFrame, name: str = "pos") -> DataFrame:
    """Chronological position over all symbols, 1..n."""
    return index_rows(df, [], [F.year("time"), F.dayofyear("time") * 24 + F.hour("time")], ["time", "symbol"], name)


def purged_splits(df: DataFrame, n: int = 5, gap: int = 12, by: Sequence[str] = ("symbol",), pos: str = "rn") -> DataFrame:
    """(row, fold, role): expanding training part, a gap, then the fold's test part. Rows are numbered 1..n per key."""
    by = list(by)
    size = (df.groupBy(*by) if by else df.groupBy()).agg(F.max(pos).alias("__n"))
    d = df.join(size, by) if by else df.crossJoin(F.broadcast(size))
    fold_size = F.floor(F.col("__n") / (n + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = (F.col("fold") + 1) * fold_size
    end = F.when(F.col("fold") < n - 1, start + fold_size).otherwise(F.col("__n"))
    i = F.col(pos) - 1
    role = F.when(i < F.greatest(start - gap, F.lit(0)), "train").when((i >= start) & (i < end), "test")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("__n")


def with_calibration_tail(fold: DataFrame, pos: str = "rn") -> DataFrame:
    """Move the newest tenth (50 to 200 rows) of a fold's training rows to the role "calib".

    Where the training part is not larger than that, the older half of a test part of at least 100 rows is taken; where
    that is too small as well, nothing is.
    """
    train, test = F.col("role") == "train", F.col("role") == "test"
    edge = fold.agg(F.count_if(train).alias("__k"), F.count_if(test).alias("__m"), F.min(F.when(test, F.col(pos))).alias("__from"))
    d = fold.crossJoin(F.broadcast(edge))
    n_cal = F.least(F.greatest(F.floor(F.col("__k") / 10), F.lit(50)), F.lit(200))
    tail = top_k_per(fold.where(train).withColumn("__g", F.lit(1)), ["__g"], [F.desc(pos)], 200).select(pos, "rank")
    d = d.join(tail, pos, "left")
    take = train & F.col("rank").isNotNull() & (F.col("rank") <= n_cal) & (n_cal < F.col("__k"))
    borrow = test & (n_cal >= F.col("__k")) & (F.col("__m") >= 100) & (F.col(pos) < F.col("__from") + F.floor(F.col("__m") / 2))
    return d.withColumn("role", F.when(take | borrow, "calib").otherwise(F.col("role"))).drop("__k", "__m", "__from", "rank")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(filled)


def class_counts(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """Negatives and positives."""
    return tuple(df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first())


def class_weight(neg: int, pos: int) -> float:
    """Negatives over positives, at most 20; 1 without negatives."""
    return float(min(neg / max(pos, 1), 20.0)) or 1.0


class Ensemble:
    """Fitted members whose positive-class probabilities are averaged; each may carry an isotonic calibrator.

    Without members every row has the probability `alone`.
    """

    def __init__(self, members, features, calibrators=(), alone: float | None = None):
        self.members, self.features, self.calibrators, self.alone = list(members), list(features), list(calibrators), alone

    def probabilities(self, df: DataFrame, out: str = "prob") -> DataFrame:
        if not self.members:
            return df.withColumn(out, F.lit(self.alone).cast("double"))
        d = _assembled(df, self.features)
        keep = df.columns
        for i, m in enumerate(self.members):
            m.setFeaturesCol("__x").setPredictionCol(f"__pred{i}").setProbabilityCol(f"__prob{i}").setRawPredictionCol(f"__raw{i}")
            d = m.transform(d).withColumn(f"__p{i}", vector_to_array(f"__prob{i}")[1])
            if i < len(self.calibrators):
                d = self.calibrators[i].setFeaturesCol(f"__p{i}").setPredictionCol(f"__c{i}").transform(d)
            else:
                d = d.withColumn(f"__c{i}", F.col(f"__p{i}"))
        total = sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"__c{i}"))) for i in range(len(self.members))), F.lit(0.0))
        return d.select(*keep, (total / len(self.members)).alias(out))

    def importances(self, spark) -> DataFrame:
        rows = [(f, float(self.members[0].featureImportances[i]) if self.members else 0.0) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, importance double")


def train_ensemble(df: DataFrame, features: Sequence[str], label: str = "label", p: Mapping = SMALL) -> Ensemble:
    """Boosted trees and a random forest on class-weighted rows; rows without a label are left out.

    Nothing can be fitted to one class: its probability is 0 or 1 then, and unknown without any row.
    """
    neg, pos = class_counts(df, label)
    if not neg or not pos:
        return Ensemble([], features, alone=float(pos > 0) if neg or pos else None)
    df, w = df.where(F.col(label).isNotNull()), class_weight(neg, pos)
    d = _assembled(df, features).withColumn("__w", F.when(F.col(label) == 1, w).otherwise(1.0)).withColumn("__y", F.col(label).cast("double"))
    d = d.select("__x", "__y", "__w").cache()
    common = dict(featuresCol="__x", labelCol="__y", weightCol="__w", seed=p["seed"], maxDepth=p["depth"], subsamplingRate=0.8)
    gbt = GBTClassifier(maxIter=p["trees"], stepSize=p["rate"], **common).fit(d)
    rf = RandomForestClassifier(numTrees=p["trees"], **common).fit(d)
    d.unpersist()
    return Ensemble([gbt, rf], features)


def calibrate(model: Ensemble, holdout: DataFrame, label: str = "label", min_rows: int = 50) -> Ensemble:
    """Isotonic calibration of every member on rows the members were not fitted on; too few rows leave it as it is."""
    if not model.members or holdout.limit(min_rows).count() < min_rows:
        return model
    cals = []
    for m in model.members:
        p = Ensemble([m], model.features).probabilities(holdout, "__p").select("__p", F.col(label).cast("double").alias("__y"))
        cals.append(IsotonicRegression(featuresCol="__p", labelCol="__y").fit(p))
    return Ensemble(model.members, model.features, cals)


def train_fold(split: DataFrame, fold: int, features: Sequence[str], pos: str = "rn", p: Mapping = SMALL) -> tuple[Ensemble, DataFrame]:
    """One fold: fit on its training rows, calibrate on their tail, predict its test rows (column prob)."""
    rows = with_calibration_tail(split.where(F.col("fold") == fold), pos).cache()
    model = calibrate(train_ensemble(rows.where(F.col("role") == "train"), features, p=p), rows.where(F.col("role") == "calib"))
    return model, model.probabilities(rows.where(F.col("role") == "test"))


def out_of_fold(df: DataFrame, features: Sequence[str], n: int, gap: int, pos: str = "pos", p: Mapping = SMALL) -> DataFrame:
    """Test predictions of all folds (the fold count is a parameter)."""
    split = purged_splits(df, n, gap, by=(), pos=pos)
    out = None
    for k in range(n):
        _, pred = train_fold(split, k, features, pos, p)
        out = pred if out is None else out.unionByName(pred)
    return out


def best_threshold(pred: DataFrame, rr: float = 2.0, min_trades: int = 60, prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold of 0.30 .. 0.85 with the largest tp * rr - fp among those with enough trades; 0.5 if none.

    Rows are bucketed by the highest threshold they pass and summed from above, so no row is copied per threshold.
    """
    by = list(by)
    passed = F.least(F.floor(F.col(prob) * 100 + 1e-9), F.lit(85)).cast("int")
    b = pred.where(F.col(prob) >= 0.30).groupBy(*by, passed.alias("t")).agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    keys = pred.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    grid = keys.select("*", F.explode(F.sequence(F.lit(30), F.lit(85))).alias("t"))
    full = grid.join(b, by + ["t"], "left")
    down = Window.partitionBy(*by).orderBy(F.desc("t"))  # 56 rows
    cum = full.select(*by, "t", F.coalesce(F.sum("tp").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp").over(down), F.lit(0)).alias("fp"))
    cum = cum.withColumn("ev", F.when(F.col("tp") + F.col("fp") >= min_trades, F.col("tp") * rr - F.col("fp")))
    g = (cum.groupBy(*by) if by else cum.groupBy()).agg(F.max(F.when(F.col("ev").isNotNull(), F.struct("ev", (-F.col("t")).alias("nt"), (F.col("tp") + F.col("fp")).alias("n")))).alias("b"))
    return g.select(*by, F.coalesce(-F.col("b.nt") / 100, F.lit(0.5)).alias("threshold"), F.col("b.ev").alias("ev"), F.col("b.n").alias("trades"))


def prune_features(importances: DataFrame, keep: float = 0.7) -> DataFrame:
    """Top share of the features by importance (all of them when every importance is zero)."""
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    whole = Window.partitionBy()
    r = importances.withColumns({"rank": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole), "__s": F.sum("importance").over(whole)})
    n_keep = F.greatest(F.lit(1), F.floor(F.col("__n") * keep + 1e-9))
    return r.where((F.col("rank") <= n_keep) | (F.col("__s") == 0)).drop("__n", "__s")


def train_meta(pred: DataFrame, features: Sequence[str], pos: str = "pos", p: Mapping = SMALL) -> tuple[Ensemble | None, DataFrame]:
    """Second model for "was the primary right", chronological 80 / 20; returns it with its test predictions."""
    d = pred.where(F.col("prob").isNotNull()).withColumn("meta", F.when((F.col("prob") >= 0.5) == (F.col("label") == 1), 1).otherwise(0)).withColumn("__primary", F.col("label")).drop("label")
    d = d.withColumnRenamed("meta", "label")
    r = d.agg(F.min("label").alias("a"), F.max("label").alias("b"), F.floor(F.max(pos) * 0.8).alias("cut")).first()  # positions are 1..n
    if r["a"] == r["b"]:
        return None, d.limit(0).withColumn("meta_prob", F.lit(None).cast("double"))
    model = train_ensemble(d.where(F.col(pos) <= r["cut"]), features, p=p)
    return model, model.probabilities(d.where(F.col(pos) > r["cut"]), "meta_prob")


def train_regressor(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "r_multiple", p: Mapping = SMALL) -> DataFrame:
    """Average of boosted trees and a forest on the R multiple: test rows with `expected_r`, null if no row can be learned from."""
    train = train.where(F.col(target).isNotNull())
    if train.isEmpty():
        return test.withColumn("expected_r", F.lit(None).cast("double"))
    d = _assembled(train, features).select("__x", F.col(target).alias("__y")).cache()
    common = dict(featuresCol="__x", labelCol="__y", seed=p["seed"], maxDepth=p["depth"])
    members = [GBTRegressor(maxIter=p["trees"], stepSize=p["rate"], **common).fit(d), RandomForestRegressor(numTrees=p["trees"], **common).fit(d)]
    d.unpersist()
    out = _assembled(test, features)
    for i, m in enumerate(members):
        out = m.setPredictionCol(f"__r{i}").transform(out)
    return out.select(*test.columns, ((F.col("__r0") + F.col("__r1")) / 2).alias("expected_r"))


def train_pool(df: DataFrame, features: Sequence[str], asset_class: str, classes: Mapping[str, str], p: Mapping = SMALL) -> tuple[Ensemble, DataFrame]:
    """One model over all symbols of an asset class, calibrated on the newest rows; returns it with its metadata."""
    from tidemark.operators.projections import with_asset_class

    pool = number_rows(with_asset_class(df, classes).where(F.col("asset_class") == asset_class)).cache()
    n = pool.count()
    n_cal = min(200, max(50, int(n * 0.15)))
    n_cal = n_cal if n - n_cal >= 300 else 0
    model = train_ensemble(pool.where(F.col("pos") <= n - n_cal), features, p=p)
    model = calibrate(model, pool.where(F.col("pos") > n - n_cal)) if n_cal else model
    meta = pool.agg(F.lit(asset_class).alias("asset_class"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"), F.avg("label").alias("pos_rate"), F.lit(n_cal).alias("n_calibration"))
    return model, meta


def train_symbols(df: DataFrame, features: Sequence[str], folds: int = 3, gap: int = 20, rr: float = 2.0, p: Mapping = SMALL, single_below: int = 200) -> DataFrame:
    """Per-symbol training runs as one metadata table: rows, out-of-fold F1 and accuracy, threshold.

    The models of all symbols and folds grow together, so the jobs do not depend on the number of symbols and no list of
    them is needed. Fewer than `single_below` rows fall back to a single 80 / 20 split. A symbol whose folds leave no test
    row has its row count alone.
    """
    rows = settle(index_rows(df.drop("rn"), ["symbol"], [month_of("time")], ["time"], "rn"))
    size = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    sized = rows.join(size, "symbol")
    cut = F.floor(F.col("n_rows") * 0.8)
    single = sized.where(F.col("n_rows") < single_below).withColumn("fold", F.lit(0)).withColumn("role", F.when(F.col("rn") <= cut, "train").otherwise("test"))
    many = purged_splits(sized.where(F.col("n_rows") >= single_below), folds, gap)
    split = settle(single.unionByName(many).select("symbol", "fold", "role", "label", *features))
    key = ["symbol", "fold"]
    train = split.where(F.col("role") == "train")
    neg, pos = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    weight = train.groupBy(*key).agg(F.when(neg > 0, F.least(neg / F.greatest(pos, F.lit(1)), F.lit(20.0))).otherwise(1.0).alias("__cw"))
    weighted = train.join(weight, key).withColumn("__weight", F.when(F.col("label") == 1, F.col("__cw")).otherwise(1.0))
    models = trees.fit(weighted, key, features, weight="__weight", p=p)
    pred = settle(trees.score(split.where(F.col("role") == "test"), models, key, features).where(F.col("prob").isNotNull()))
    pred = pred.withColumn("prediction", F.when(F.col("prob") >= 0.5, 1).otherwise(0))
    hits = binary_metrics(pred, by=["symbol"]).select("symbol", "f1", "accuracy")
    found = best_threshold(pred, rr, min_trades=20, by=["symbol"]).select("symbol", "threshold")
    out = size.join(hits, "symbol", "left").join(found, "symbol", "left")
    return out.select("symbol", F.when(F.col("n_rows") < single_below, "single_split").otherwise("folds").alias("path"), "n_rows", "f1", "accuracy", "threshold")


def ml_multipliers(pred: DataFrame, threshold: Column | float, default: float = 0.55, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Buy and sell size multipliers clip(p / threshold, 0.5, 2), 0 below the threshold.

    A threshold that fewer than 0.1 % of a key's rows reach is replaced by the default.
    """
    from tidemark.functions.numbers import as_col, clip

    t0 = as_col(threshold)
    share = pred.groupBy(*by).agg(F.avg(F.when(F.col("prob") >= t0, 1.0).otherwise(0.0)).alias("__share"))
    d = pred.join(share, list(by)).withColumn("threshold_used", F.when(F.col("__share") < 0.001, default).otherwise(t0)).drop("__share")
    t = F.col("threshold_used")
    side = lambda q: F.when(q >= t, clip(q / t, 0.5, 2.0)).otherwise(0.0)
    return d.withColumn("ml_mult_buy", side(F.col("prob"))).withColumn("ml_mult_sell", side(1 - F.col("prob")))


def ml_gate(pred: DataFrame, models: DataFrame, pool_models: DataFrame, default: float = 0.55, meta_threshold: float = 0.50) -> DataFrame:
    """Pass flag and confidence of signals against their symbol's model, else the asset class pool's, else pass-through.

    `pred` has symbol, asset_class, signal, prob and meta_prob (null without a meta model); `models` / `pool_models`
    carry override and optimal thresholds. An optimal threshold relaxes to the default if that is met; the meta model
    can veto.
    """
    m = models.select("symbol", F.col("override").alias("__ov"), F.col("optimal").alias("__opt"), F.lit(True).alias("__own"))
    pl = pool_models.select("asset_class", F.col("optimal").alias("__popt"), F.lit(True).alias("__pool"))
    d = pred.join(m, "symbol", "left").join(pl, "asset_class", "left")
    has = F.coalesce("__own", "__pool", F.lit(False))
    optimal = F.when(F.col("__own"), F.col("__opt")).otherwise(F.col("__popt"))
    conf = F.when(F.col("signal") == "buy", F.col("prob")).otherwise(1 - F.col("prob"))
    t = F.coalesce("__ov", optimal, F.lit(default))
    relaxed = F.when((t == optimal) & (conf < t) & (conf >= default), default).otherwise(t)
    ok = conf >= relaxed
    veto = F.coalesce(F.col("meta_prob") < meta_threshold, F.lit(False))
    out = d.withColumns({
        "ml_pass": ~has | (ok & ~veto), "ml_conf": F.when(has, F.when(ok & veto, conf * F.col("meta_prob")).otherwise(conf)),
        "model_used": F.when(F.col("__own"), "symbol").when(F.col("__pool"), "pool").otherwise("none"),
    })
    return out.drop("__ov", "__opt", "__own", "__popt", "__pool")


def tune(df: DataFrame, features: Sequence[str], grid: Sequence[Mapping], folds: int = 3, pos: str = "pos") -> DataFrame:
    """Mean log-loss of expanding folds per parameter set, best first (the grid is the search budget)."""
    split = purged_splits(df, folds, 0, by=(), pos=pos).cache()
    out = None
    for i, p in enumerate(grid):
        for k in range(folds):
            rows = split.where(F.col("fold") == k)
            pred = train_ensemble(rows.where(F.col("role") == "train"), features, p=p).probabilities(rows.where(F.col("role") == "test"))
            q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("prob")))
            loss = pred.where(F.col("prob").isNotNull()).agg(F.lit(i).alias("grid_id"), F.lit(k).alias("fold"), F.avg(-F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
            out = loss if out is None else out.unionByName(loss)
    return out.groupBy("grid_id").agg(F.avg("log_loss").alias("log_loss"), F.count(F.lit(1)).alias("folds")).orderBy(F.asc_nulls_last("log_loss"), "grid_id")


def retrain(df: DataFrame, drifted: DataFrame, features: Sequence[str], recent: int = 500, holdout: float = 0.2, p: Mapping = SMALL) -> DataFrame:
    """Refit on the newest `recent` rows of the symbols a drift check flagged, all of them at once; one line per symbol.

    The accuracy is that on the newest `holdout` share of these rows, which the model has not seen.
    """
    names = drifted.where("drift").select("symbol").distinct()
    rows = settle(top_k_per(df.join(names, "symbol", "left_semi"), ["symbol"], [F.desc("rn")], recent))
    held = F.floor(F.col("__n") * holdout)
    rows = rows.join(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n")), "symbol")
    models = trees.fit(rows.where(F.col("rank") > held), ["symbol"], features, p=p)
    pred = trees.score(rows.where(F.col("rank") <= held), models, ["symbol"], features)
    right = F.when((F.col("prob") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)
    return pred.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(right).alias("accuracy"))
