"""Language of a text by a convolutional network over its bytes, trained with NumPy on labelled rows.

Filters of several widths slide over windows of fixed length, each keeps its largest answer in a window (max pooling,
cut at zero), and a softmax over these names the language of the window. A document has the language with the highest
mean log probability over all its windows, each weighted by its bytes.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import release, slices

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
#: Windows evaluated at a time.
BLOCK = 128
HAS_LETTER = re.compile(r"[^\W\d_]").search


@dataclasses.dataclass
class Model:
    labels: list[str]
    taps: list[np.ndarray]  # for each width w: (w, 256, FILTERS), what a byte at each place adds
    bias: np.ndarray  # (filters of all widths)
    dense: np.ndarray  # (filters of all widths, labels)
    shift: np.ndarray  # (labels)


def fill(text: str, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    raw = text.lower().encode("utf-8", "replace")
    out = np.zeros(max(1, -(-len(raw) // length)) * length, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, length)


def _answers(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Per width: answers of the filters at all places of all windows, before pooling."""
    return [sum(taps[k][x[:, k : WINDOW - w + 1 + k]] for k in range(w)) for w, taps in zip(WIDTHS, model.taps)]


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 17) -> Model:
    """Softmax regression on pooled filters by Adam; everything follows from the seed."""
    rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    model = Model(
        labels, [(rng.normal(0, 0.3, (w, 256, FILTERS)) / np.sqrt(w)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    values = [*model.taps, model.bias, model.dense, model.shift]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    while step < steps:
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            x, y = windows[some], target[some]
            places, tops = [], []
            for a in _answers(model, x):
                places.append(a.argmax(1))
                tops.append(np.take_along_axis(a, places[-1][:, None], 1)[:, 0])
            pooled = np.concatenate(tops, 1) + model.bias
            kept = np.maximum(pooled, 0)
            z = kept @ model.dense + model.shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ model.dense.T) * (pooled > 0)
            slopes = []
            for j, (w, taps) in enumerate(zip(WIDTHS, model.taps)):
                slope, part = np.zeros_like(taps), back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(slope[k], (np.take_along_axis(x, places[j] + k, 1), np.arange(FILTERS)), part)
                slopes.append(slope)
            slopes += [back.sum(0), kept.T @ p + 1e-4 * model.dense, p.sum(0)]
            step += 1
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


class Scorer:
    """The trained network with tables of two neighbouring bytes, so that a filter of width w takes w / 2 lookups."""

    def __init__(self, model: Model):
        self.model, self.steps = model, []
        for w, taps in zip(WIDTHS, model.taps):
            pairs = [((taps[k][:, None] + taps[k + 1][None]).reshape(1 << 16, FILTERS), k) for k in range(0, w - 1, 2)]
            self.steps.append((w, pairs, taps[w - 1] if w % 2 else None))

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the labels for each window."""
        out = np.empty((len(x), len(self.model.labels)))
        for i in range(0, len(x), BLOCK):
            own = x[i : i + BLOCK]
            pair = own[:, :-1].astype(np.int64) << 8 | own[:, 1:]
            tops = []
            for w, pairs, single in self.steps:
                n = WINDOW - w + 1
                a = pairs[0][0].take(pair[:, :n], 0)
                for table, k in pairs[1:]:
                    a += table.take(pair[:, k : k + n], 0)
                if single is not None:
                    a += single.take(own[:, w - 1 :], 0)
                tops.append(a.max(1))
            z = np.maximum(np.concatenate(tops, 1) + self.model.bias, 0) @ self.model.dense + self.model.shift
            z -= z.max(1, keepdims=True)
            out[i : i + BLOCK] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and its probability for each text; `und` with 0 where there is no letter, or nothing was learned."""
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and HAS_LETTER(t)] if self.model.labels else []
        if not some:
            return names, score
        parts = [fill(texts[i]) for i in some]
        x = np.concatenate(parts)
        weight = (x != 0).sum(1).astype(float)
        at = np.cumsum([0] + [len(p) for p in parts])[:-1]
        z = np.add.reduceat(self.log_shares(x) * weight[:, None], at) / np.maximum(np.add.reduceat(weight, at), 1)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score[some] = p[np.arange(len(some)), best]
        for i, b in zip(some, best):
            names[i] = self.model.labels[b]
        return names, score


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % parts


def fit(docs: DataFrame, per_label: int = 600, windows_per_row: int = 3) -> Model:
    """Train on at most `per_label` rows of each value of `lang` (the lowest hashes of doc_id and text), from each of which
    `windows_per_row` windows are taken, evenly spaced over the text. This bounded sample is all that reaches the driver.

    `docs` has doc_id, text and lang; rows without label or without a letter are not used. Rows that repeat doc_id, text and
    label count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label
    labels = sorted(counts)
    if not labels:
        return Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    # A thin slice of hashes is looked at first; only where equal rows leave too little of it, all are.
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, min(1.0, (2.0 * per_label + 50) / counts[k]))])
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0))
    cut = [F.substr("text", (F.lit(1) + F.floor(room * i / max(1, windows_per_row - 1))).cast("int"), F.lit(WINDOW)) for i in range(windows_per_row)]
    least = Window.partitionBy("lang").orderBy("h")

    def drawn(of: DataFrame) -> DataFrame:
        once = of.groupBy("lang", "h").agg(F.first(F.array(*cut)).alias("cut"))
        return once.withColumn("place", F.row_number().over(least)).where(F.col("place") <= per_label).select("lang", "h", "cut")

    some = drawn(rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))).toPandas()
    held = some.groupby("lang").size()
    if any(held.get(k, 0) < min(per_label, counts[k]) for k in labels):
        some = drawn(rows).toPandas()
    some = some.sort_values(["lang", "h"])
    windows = np.concatenate([fill(t)[0] for row in some["cut"] for t in row]).reshape(-1, WINDOW)
    target = np.repeat([labels.index(v) for v in some["lang"]], windows_per_row)
    return train(windows, target, labels)


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of `docs`, lang_pred and score for every whole text; a named column of one of these two names is the answer's.

    `und` (score 0): null or empty text, text without a letter, or a model that has learned nothing. Repeated rows get
    the same answer each. Columns of `docs` that are not named don't reach the result; only the text is looked at.
    """
    kept = [c for c in columns if c not in ("lang_pred", "score")]
    inside = [f"__c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, "__text", 2 << 20):
            names, score = scorer.predict(b["__text"].to_pylist())
            yield pa.record_batch([*(b[c] for c in inside), pa.array(names), pa.array(score)], [*inside, "lang_pred", "score"])
        del scorer
        release()

    rows = docs.select(*[docs[c].alias(n) for c, n in zip(kept, inside)], docs["text"].cast("string").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double" if schema else "lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, inside)], "lang_pred", "score")
