"""Training rows of one class, or none at all."""

from pyspark.sql import functions as F

from tidemark.operators import ml, trees

X = ["x"]
P = {"trees": 2, "depth": 2, "rate": 0.5, "bins": 8, "seed": 42}


def rows(spark, n, label):
    return spark.range(1, n + 1).selectExpr("'a' AS symbol", "id AS rn", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) AS time", "id * 1.0D AS x", f"{label} AS label", "id * 0.5D AS r_multiple")


def probabilities(df, test, p=P):
    model = ml.calibrate(ml.train_ensemble(df, X, p=p), df)
    return [r["prob"] for r in model.probabilities(test).collect()], [r["importance"] for r in model.importances(df.sparkSession).collect()]


def test_ensemble_of_one_class_or_none(spark):
    """train_ensemble, train_fold_calibrated, calibration_curve: no error, and no row is lost."""
    test = rows(spark, 5, "0")
    for label, n, prob in (("1", 60, 1.0), ("0", 60, 0.0), ("0", 0, None)):
        got, weight = probabilities(rows(spark, n, label), test)
        assert got == [prob] * 5 and weight == [0.0]
    split = ml.purged_splits(rows(spark, 6, "1"), 2, 10, by=())
    _, pred = ml.train_fold(split, 1, X, "rn", P)  # the gap leaves no training row
    assert [(r["rn"], r["prob"]) for r in pred.orderBy("rn").collect()] == [(5, None), (6, None)]


def test_regressor_without_training_rows(spark):
    test = rows(spark, 3, "1")
    got = ml.train_regressor(rows(spark, 0, "1"), test, X, p=P)
    assert [r["expected_r"] for r in got.collect()] == [None] * 3


def test_meta_model_on_rows_of_one_class(spark):
    right = rows(spark, 10, "1").withColumn("prob", F.when(F.col("rn") <= 9, 0.9).otherwise(0.1)).withColumn("pos", F.col("rn"))
    model, pred = ml.train_meta(right, X, p=P)  # the first eight are all right
    assert model is not None and [(r["pos"], r["meta_prob"]) for r in pred.orderBy("pos").collect()] == [(9, 1.0), (10, 1.0)]
    assert ml.train_meta(right.withColumn("prob", F.lit(None).cast("double")), X, p=P)[1].count() == 0


def test_symbols_whose_training_rows_are_all_positive(spark):
    """symbol_training_runs: weights of zero were a division by zero."""
    got = ml.train_symbols(rows(spark, 10, "CASE WHEN id < 9 THEN 1 ELSE 0 END"), X, folds=2, gap=1, p=P).collect()
    assert [(r["symbol"], r["path"], r["n_rows"], r["accuracy"]) for r in got] == [("a", "single_split", 10, 0.0)]
    weighted = rows(spark, 4, "1").withColumn("w", F.lit(0.0))
    assert trees.fit(weighted, ["symbol"], X, weight="w", p=P).count() == 1


def test_search_without_training_rows(spark):
    got = ml.tune(rows(spark, 3, "1").withColumn("pos", F.col("rn")), X, [P, {**P, "depth": 1}], folds=3).collect()
    assert [r["grid_id"] for r in got] == [0, 1]
