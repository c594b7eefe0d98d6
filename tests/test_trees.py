"""Trees of many keys against a plain version that grows them one key at a time."""

import bisect
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import ml, trees

X = ["x", "y", "z"]
P = {"trees": 3, "depth": 2, "rate": 0.5, "bins": 8, "ridge": 1.0, "min_rows": 5}
SCHEMA = "symbol string, id int, x double, y double, z double, label int"


def sample(n=900, seed=5):
    draw, rows = random.Random(seed), []
    for i in range(n):
        x, y, z = draw.random(), draw.gauss(0, 1), draw.choice([None, float("nan"), 0.25, 1.0])
        key = "a" if i % 3 else "b"
        rows.append((key, i, x, y, z, int((x > 0.4) != (key == "b" and y > 0)) if draw.random() > 0.1 else draw.randint(0, 1)))
    return rows + [("one class", n + i, float(i), 1.0, 1.0, 1) for i in range(20)] + [("few", n + 50, 1.0, 2.0, 3.0, 0), (None, n + 60, 1.0, 1.0, 1.0, 1), ("a", n + 61, 1.0, 1.0, 1.0, None)]


def plain(rows, edges):
    """Predictions of a key's rows after all trees; `edges` per feature."""
    known = lambda v: 0.0 if v is None or math.isnan(v) else v
    bins = [[bisect.bisect_left(e, known(v)) for e, v in zip(edges, r[2:5])] for r in rows]
    label = [r[5] for r in rows]
    mean = min(max(sum(label) / len(label), 1e-6), 1 - 1e-6)
    score = [math.log(mean / (1 - mean))] * len(rows)
    for _ in range(P["trees"]):
        chance = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y - c for y, c in zip(label, chance)], [c * (1 - c) for c in chance]

        def grow(part, depth):
            total = lambda a, some: sum(a[i] for i in some)
            worth = lambda some: total(g, some) ** 2 / (total(h, some) + P["ridge"])
            best = None
            if depth < P["depth"]:
                for f in range(3):
                    for b in range(P["bins"]):
                        left, right = [i for i in part if bins[i][f] <= b], [i for i in part if bins[i][f] > b]
                        if min(len(left), len(right)) >= P["min_rows"]:
                            gain = round(worth(left) + worth(right) - worth(part), 9)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = gain, left, right
            if best:
                return {**grow(best[1], depth + 1), **grow(best[2], depth + 1)}
            value = total(g, part) / (total(h, part) + P["ridge"]) if depth else 0.0
            return {i: value for i in part}

        leaf = grow(list(range(len(rows))), 0)
        score = [s + P["rate"] * leaf[i] for i, s in enumerate(score)]
    return {r[1]: 1 / (1 + math.exp(-s)) for r, s in zip(rows, score)}


def test_trees_of_all_keys_equal_plain_ones(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    models = trees.fit(df, ["symbol"], X, p=P)
    found = {r["symbol"]: r for r in models.collect()}
    assert set(found) == {"a", "b", "one class", "few"} and found["few"]["trees"] == [] and found["one class"]["trees"] == []
    got = {r["id"]: r["prob"] for r in trees.score(df, models, ["symbol"], X).collect()}
    for key, m in found.items():
        own = [r for r in rows if r[0] == key and r[5] is not None]
        for i, p in plain(own, m["edges"]).items():
            assert math.isclose(got[i], p, rel_tol=1e-9), (key, i)
    assert len(got) == len(rows) and [got[r[1]] for r in rows if r[0] is None] == [None]
    share = {(r["symbol"], r["feature"]): r["importance"] for r in trees.importances(models, ["symbol"], X).collect()}
    assert share["a", "x"] > 0.9 and share["b", "y"] > 0.05 and share["few", "x"] == 0
    hits = [(got[r[1]] >= 0.5) == (r[5] == 1) for r in rows if r[0] == "a" and r[5] is not None]
    assert sum(hits) / len(hits) > 0.85


def test_trees_on_numbers_and_empty_table(spark):
    df = spark.createDataFrame(sample(300), SCHEMA).where("symbol = 'a'").withColumn("label", 3 * F.col("x"))
    models = trees.fit(df, ["symbol"], X, loss="squares", p={**P, "trees": 2, "rate": 1.0, "bins": 16})
    off = trees.score(df, models, ["symbol"], X, "squares", "guess").agg(F.avg(F.abs(F.col("guess") - F.col("label")))).first()[0]
    assert off < 0.25
    none = trees.fit(df.limit(0), ["symbol"], X, p={**P, "trees": 1})
    assert none.count() == 0 and trees.score(df, none, ["symbol"], X).where("prob IS NOT NULL").count() == 0


def test_symbols_train_together(spark):
    rows = [(s, i, x, y, z or 0.0, label) for s, i, x, y, z, label in sample() if s in ("a", "b") and label is not None]
    rows += [("short", 5000 + i, i / 60, 0.0, 0.0, int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("symbol", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, id) AS time", "id AS rn", "x", "y", "z", "label")
    out = {r["symbol"]: r for r in ml.train_symbols(df, X, folds=2, gap=3, p={**P, "trees": 2}).collect()}
    assert set(out) == {"a", "b", "short"}
    assert out["short"]["path"] == "single_split" and out["short"]["n_rows"] == 60
    assert out["a"]["path"] == "folds" and out["a"]["accuracy"] > 0.8 and out["a"]["f1"] > 0.8
