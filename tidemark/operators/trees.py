"""Boosted histogram trees for many keys at once.

One key (a symbol, or a symbol and a fold) has one model, and all models grow together: a level of all trees is one
aggregation over (key, node, feature, bin), so the number of jobs depends on trees and depth, not on the number of
keys. Sums are combined before the shuffle, hence a key with a third of all rows is no more than its histogram there.
A model is one row per key and meets the rows by a join; nothing is gathered on the driver.

Losses: "logistic" for labels 0 and 1, "squares" for numbers. Splits maximise the usual second-order gain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

DEFAULTS = {"trees": 10, "depth": 3, "rate": 0.1, "bins": 16, "ridge": 1.0, "min_rows": 5}
NODE = "struct<f: int, b: int, v: double>"


def _known(col: str) -> Column:
    return F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(0.0)), F.lit(0.0))


def _bins(features: Sequence[str], edges: Column) -> Column:
    """Bin number of every feature: how many of its key's edges lie below the value (unknown values count as 0.0)."""

    def one(i: int, col: str) -> Column:
        return F.size(F.filter(F.coalesce(edges[i], F.array().cast("array<double>")), lambda e: e < _known(col)))

    return F.array(*[one(i, c) for i, c in enumerate(features)])


def edges_of(df: DataFrame, by: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """One row per key: for every feature the distinct cuts between `bins` parts of about equal size, in order."""
    shares = [k / bins for k in range(1, bins)]
    cuts = [F.array_sort(F.array_distinct(F.percentile_approx(_known(c), shares, 10_000))) for c in features]
    return df.groupBy(*by).agg(F.array(*cuts).alias("edges"))


def _walk(tree: Column, bins: Column, depth: int | Column) -> Column:
    """Number of the node at which a row ends in a tree of at most `depth` splits: 1, then 2 n or 2 n + 1."""

    def step(node: Column, _) -> Column:
        at = F.try_element_at(tree, node)
        return F.when(at["f"].isNull(), node).otherwise(node * 2 + (F.get(bins, at["f"]) > at["b"]).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth) if isinstance(depth, int) else depth), F.lit(1), step)


def _best_splits(rows: DataFrame, by: Sequence[str], ridge: float, min_rows: int) -> DataFrame:
    """The split of greatest gain per (key, node); equal gains go to the lower feature and bin. `rows` hold g and h."""
    flat = rows.select(*by, "node", "g", "h", F.posexplode("bins").alias("f", "b"))
    cells = flat.groupBy(*by, "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*by, "node", "f").orderBy("b")  # at most `bins` rows
    whole = Window.partitionBy(*by, "node", "f")
    c = cells.select(
        *by, "node", "f", "b", F.sum("g").over(below).alias("gl"), F.sum("h").over(below).alias("hl"), F.sum("n").over(below).alias("nl"),
        F.sum("g").over(whole).alias("ga"), F.sum("h").over(whole).alias("ha"), F.sum("n").over(whole).alias("na"),
    )
    gr, hr, nr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl"), F.col("na") - F.col("nl")
    worth = lambda g, h: g * g / (h + ridge)
    gain = worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("ga"), F.col("ha"))
    c = c.where((F.col("nl") >= min_rows) & (nr >= min_rows)).select(
        *by, "node", F.round(gain, 9).alias("gain"), (-F.col("f")).alias("nf"), (-F.col("b")).alias("nb"),
        (F.col("gl") / (F.col("hl") + ridge)).alias("vl"), (gr / (hr + ridge)).alias("vr"),
    )
    best = c.where(F.col("gain") > 1e-9).groupBy(*by, "node").agg(F.max(F.struct("gain", "nf", "nb", "vl", "vr")).alias("s"))
    return best.select(*by, "node", (-F.col("s.nf")).alias("f"), (-F.col("s.nb")).alias("b"), F.col("s.vl").alias("vl"), F.col("s.vr").alias("vr"), F.col("s.gain").alias("gain"))


def _nodes(grown: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nodes of grown trees: splits with feature and bin, ends with a value."""
    child = lambda step, v: F.struct((F.col("node") * 2 + step).alias("node"), F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("b"), F.col(v).alias("v"))
    split = F.struct("node", "f", "b", F.lit(None).cast("double").alias("v"))
    flat = grown.select(*by, F.explode(F.array(split, child(0, "vl"), child(1, "vr"))).alias("n")).select(*by, "n.*")
    return flat.groupBy(*by, "node").agg(F.max("f").alias("f"), F.max("b").alias("b"), F.max("v").alias("v"))


def _trees(grown: DataFrame, by: Sequence[str]) -> DataFrame:
    """One map of nodes per key; a tree has 2 ** (depth + 1) nodes at most."""
    return _nodes(grown, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "b", "v")))).alias("tree"))


def fit(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str = "label", weight: str | None = None, loss: str = "logistic", p: Mapping = {}) -> DataFrame:
    """One model per key: key columns, edges, base, rate, depth, trees (a map of nodes per tree), gains (per feature).

    Rows without a label or key are left out; a key whose rows can't be split has the base value alone. Every level
    writes its splits (a row per open node) and every tree its rows' scores, so lineage stays short.
    """
    p, by = {**DEFAULTS, **p}, list(by)
    used = df.where(F.col(label).isNotNull()).dropna(subset=by)
    edges = settle(edges_of(used, by, features, p["bins"]))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = used.join(edges, by).select(*by, F.col(label).cast("double").alias("__y"), w.alias("__w"), _bins(features, F.col("edges")).alias("bins"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("__w") * F.col("__y")), F.sum("__w")), F.avg("__y"))
    held = F.greatest(F.least(mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    base = settle(rows.groupBy(*by).agg((F.log(held / (1 - held)) if loss == "logistic" else mean).alias("base")))
    rows = settle(rows.join(base, by).withColumnRenamed("base", "score"))
    chance = 1 / (1 + F.exp(-F.col("score")))
    slopes = {
        "g": F.col("__w") * (F.col("__y") - (chance if loss == "logistic" else F.col("score"))),
        "h": F.col("__w") * (chance * (1 - chance) if loss == "logistic" else F.lit(1.0)),
    }
    forest = []
    for number in range(p["trees"]):
        grown = None
        for level in range(p["depth"]):
            state = rows.withColumns(slopes)
            if grown is None:
                state = state.withColumn("node", F.lit(1))
            else:  # rows that ended above this level are done
                state = state.join(_trees(grown, by), by).withColumn("node", _walk(F.col("tree"), F.col("bins"), level)).where(F.col("node") >= 2**level).drop("tree")
            found = settle(_best_splits(state, by, p["ridge"], p["min_rows"]))
            grown = found if grown is None else grown.unionByName(found)
        forest.append(grown.withColumn("number", F.lit(number)))
        if number + 1 < p["trees"]:
            value = F.try_element_at(F.col("tree"), _walk(F.col("tree"), F.col("bins"), p["depth"]))["v"]
            rows = rows.join(_trees(grown, by), by, "left").withColumn("score", F.col("score") + float(p["rate"]) * F.coalesce(value, F.lit(0.0))).drop("tree")
            rows = settle(rows)
    whole = forest[0]
    for grown in forest[1:]:
        whole = whole.unionByName(grown)
    trees = _nodes(whole, [*by, "number"]).groupBy(*by, "number").agg(F.array_sort(F.collect_list(F.struct("node", F.struct("f", "b", "v")))).alias("n"))
    trees = trees.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("t")).select(*by, F.transform("t", lambda t: F.map_from_entries(t["n"])).alias("trees"))
    gains = whole.groupBy(*by).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("f") == i, F.col("gain"))), F.lit(0.0)) for i in range(len(features))]).alias("gains"))
    models = edges.join(base, by).join(trees, by, "left").join(gains, by, "left")
    none = F.expr(f"CAST(array() AS array<map<int, {NODE}>>)")
    return settle(models.select(
        *by, "edges", "base", F.lit(float(p["rate"])).alias("rate"), F.lit(p["depth"]).alias("depth"), F.coalesce("trees", none).alias("trees"),
        F.coalesce("gains", F.array_repeat(F.lit(0.0), len(features))).alias("gains"),
    ))


def score(df: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], loss: str = "logistic", out: str = "prob") -> DataFrame:
    """Rows with their key's prediction; rows of a key without a model have null."""
    by = list(by)
    m = models.select(*by, F.col("edges").alias("__edges"), F.col("base").alias("__base"), F.col("rate").alias("__rate"), F.col("depth").alias("__depth"), F.col("trees").alias("__trees"))
    d = df.join(m, by, "left").withColumn("__bins", _bins(features, F.col("__edges")))
    leaf = lambda tree: F.coalesce(F.try_element_at(tree, _walk(tree, F.col("__bins"), F.col("__depth")))["v"], F.lit(0.0))
    total = F.col("__base") + F.aggregate("__trees", F.lit(0.0), lambda acc, tree: acc + F.col("__rate") * leaf(tree))
    answer = 1 / (1 + F.exp(-total)) if loss == "logistic" else total
    return d.withColumn(out, answer).select(*df.columns, out)


def importances(models: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Key, feature, importance: the share of a key's total gain."""
    names = F.array(*[F.lit(f) for f in features])
    total = F.aggregate("gains", F.lit(0.0), lambda a, x: a + x)
    d = models.select(*by, total.alias("__t"), F.explode(F.arrays_zip(names.alias("feature"), F.col("gains").alias("importance"))).alias("x"))
    return d.select(*by, F.col("x.feature").alias("feature"), F.when(F.col("__t") > 0, F.col("x.importance") / F.col("__t")).otherwise(0.0).alias("importance"))
