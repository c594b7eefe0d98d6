"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark, memory-mapped by the scoring workers.

1. Words are counted; the table of words is kept as sorted arrays of 64-bit hashes and counts in parts of the hash range.
   The place of a word in the whole table is its number.
2. Pairs of neighbouring words (number << 32 | number) are counted into sorted arrays in parts by their hash.
3. For every word: the number of distinct words before it, and as a context its total and how many pairs occur once,
   twice and more often. Discounts follow from the counts of counts.
4. Workers map the arrays and score documents; a table is never loaded as a whole and never passes the driver, which
   only sees one row per part.

Counts travel between tasks as compressed sorted arrays, one per task and part, instead of one row each.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import hashes, joined, mix, not_space, runs, slices
from tidemark.session import scratch_dir, settle

#: Keys that a task gathers before it passes them on, and keys that share a part.
GATHER, PART_KEYS = 4_000_000, 2_000_000


class Store:
    """Arrays in the shared folder. A folder on a file system is mapped in place; of others a worker keeps a copy
    whose name is removed as soon as it is open, so nothing stays behind."""

    def __init__(self, uri: str):
        self.uri, at = uri, urlparse(uri)
        self.local = at.path if at.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, data: np.ndarray) -> str:
        """Write an array under a new name; a name counts only once its task has returned it."""
        raw = np.ascontiguousarray(data)
        name = f"{uuid.uuid4().hex}.{raw.dtype.str[1:]}"
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            raw.tofile(f"{self.local}/{name}")
        else:
            files, path = self._remote()
            with files.open_output_stream(f"{path}/{name}") as f:
                f.write(raw.tobytes())
        return name

    def get(self, name: str) -> np.ndarray:
        kind = "<" + name.rpartition(".")[2]
        if self.local:
            path, copy = f"{self.local}/{name}", None
        else:
            files, folder = self._remote()
            with files.open_input_stream(f"{folder}/{name}") as f, tempfile.NamedTemporaryFile(delete=False) as copy:
                while block := f.read(1 << 24):
                    copy.write(block)
            path = copy.name
        out = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        if copy:
            os.unlink(path)
        return out


def squeeze(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys and their values: differences, bytes of equal weight side by side, compressed."""
    planes = [np.diff(keys.astype("<u8"), prepend=np.uint64(0)), *(v.astype("<u8") for v in values)]
    raw = b"".join(p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in planes)
    return len(keys).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 8 * n * columns, "zstd", asbytes=True), np.uint8)
    planes = [np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<u8").ravel() for i in range(columns)]
    planes[0] = np.cumsum(planes[0], dtype=np.uint64)
    return planes


def sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values (without values: how often each key occurs)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    if not values:
        return [keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)]
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def _shares(part: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed keys and values of each part; keys are sorted."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        own = order[a:b]
        yield int(part[own[0]]), squeeze(keys[own], *(v[own] for v in values))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _packed(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array([p for p, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})


def _counted(source: DataFrame, text: str, keys_of: Callable[[pa.RecordBatch], np.ndarray], part_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """part, blob: counts of the keys of all texts, summed up within a task GATHER keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = sums(*(np.concatenate(c) for c in zip(*held)))
            return _packed(list(_shares(part_of(keys), keys, n)))

        for b in slices(batches, text, 2 << 20):
            held.append(sums(keys_of(b)))
            size += len(held[-1][0])
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return source.mapInArrow(run, "part long, blob binary")


def _by_part(packed: DataFrame, parts: int, columns: int, finish: Callable[[int, list[np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """All blobs of a part brought together, summed and handed to `finish`, whose rows are the result."""
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(part: int, blobs: list[bytes]) -> pa.RecordBatch:
            total = sums(*(np.concatenate(c) for c in zip(*(expand(b, columns) for b in blobs))))
            rows = list(finish(part, total))
            return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

        now, blobs = None, []
        for b in batches:
            for part, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist()):
                if blobs and part != now:
                    yield close(now, blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield close(now, blobs)

    return packed.repartition(min(parts, 100_000), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all words (A-Z in lower case, apart by white space of ASCII) and of an end per text."""
    buf, at = joined(texts)
    if len(buf):
        buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    start, end = runs(not_space()[buf], at)
    doc = np.searchsorted(at, start, "right") - 1
    ends = np.searchsorted(doc, np.arange(len(texts)), "right")
    h = np.insert(hashes(buf, start, end), ends, END)
    return h, np.insert(doc, ends, np.arange(len(texts)))


#: The end of a text: a hash that no word gets by construction but by chance.
END = mix(np.array([0xE0D], np.uint64))[0]


class Words:
    """The mapped table of words: numbers and counts of hashes."""

    def __init__(self, store: Store, parts: list[tuple[int, int, str, str]], total: int):
        self.total = total
        self.keys = [store.get(k) for _, _, k, _ in parts]
        self.counts = [store.get(c) for _, _, _, c in parts]
        self.first = np.cumsum([0] + [n for _, n, _, _ in parts])

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each sorted distinct hash."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = _part(h, len(self.keys))
        edges = np.searchsorted(part, np.arange(len(self.keys) + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b and len(keys := self.keys[p]):
                at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
                hit = keys[at] == h[a:b]
                number[a:b] = np.where(hit, at + self.first[p], -1)
                count[a:b] = np.where(hit, self.counts[p][at], 0)
        return number, count

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, count and text of all tokens."""
        h, doc = tokens(texts)
        distinct, back = np.unique(h, return_inverse=True)
        number, count = self.look_up(distinct)
        return number[back], count[back], doc


def _pairs(number: np.ndarray, doc: np.ndarray, start: int) -> np.ndarray:
    """number << 32 | number of each token and the one before; the first of a text follows `start`."""
    before = np.concatenate([[start], number[:-1]])
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = start
    return before.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of entries that occur 1, 2, 3 and 4 times."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), float(k)) for k in (1, 2, 3))


class Scorer:
    def __init__(self, model: dict):
        store = Store(model["folder"])
        self.words = Words(store, model["words"], model["n"])
        self.v, self.n = model["v"], model["n"]
        self.pair_keys = {p: store.get(k) for p, _, k, _, *_ in model["pairs"]}
        self.pair_counts = {p: store.get(c) for p, _, _, c, *_ in model["pairs"]}
        self.parts = model["pair_parts"]
        self.stats = {p: store.get(s).reshape(5, -1) for p, s in model["stats"]}
        self.span = model["span"]
        self.high, self.low = np.array([0, *discounts(model["high"])]), np.array([0, *discounts(model["low"])])
        self.distinct = model["distinct"]
        self.rest = float(np.dot(self.low[1:], model["low_n"])) / self.distinct if self.distinct else 1.0

    def facts(self, number: np.ndarray) -> np.ndarray:
        """The five statistics of each word number; zeros for unknown ones."""
        out = np.zeros((5, len(number)), np.int64)
        part = number // self.span
        for p in np.unique(part[number >= 0]):
            own = np.flatnonzero((part == p) & (number >= 0))
            if int(p) in self.stats:
                out[:, own] = self.stats[int(p)][:, number[own] - p * self.span]
        return out

    def pair_count(self, key: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(key, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        part = _part(mix(distinct), self.parts)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            own = order[a:b]
            keys = self.pair_keys.get(int(part[own[0]]))
            if keys is not None and len(keys):
                at = np.minimum(np.searchsorted(keys, distinct[own]), len(keys) - 1)
                count[own] = np.where(keys[at] == distinct[own], self.pair_counts[int(part[own[0]])][at], 0)
        return count[back]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        number, count, doc = self.words.numbered(texts)
        known = number >= 0
        distinct, back = np.unique(number, return_inverse=True)
        facts = self.facts(distinct)
        # Lower order: how many different words precede this one, with what the discounts leave spread over all words.
        ahead = facts[0]
        low = np.maximum(ahead - self.low[np.minimum(ahead, 3)], 0) / max(self.distinct, 1) + self.rest / (self.v + 1)
        context = np.concatenate([[self.v], number[:-1]])
        context[np.flatnonzero(np.diff(doc, prepend=-1))] = self.v
        seen, again = np.unique(context, return_inverse=True)
        _, total, once, twice, more = self.facts(seen)
        gamma = np.where(total > 0, (self.high[1] * once + self.high[2] * twice + self.high[3] * more) / np.maximum(total, 1), 1.0)
        both = known & (context >= 0)
        c = np.zeros(len(number), np.int64)
        c[both] = self.pair_count(context[both].astype(np.uint64) << np.uint64(32) | number[both].astype(np.uint64))
        p = np.maximum(c - self.high[np.minimum(c, 3)], 0) / np.maximum(total[again], 1) + gamma[again] * low[back]
        add = lambda x: np.bincount(doc, x, len(texts))
        base = np.log10((count + 1) / (self.n + self.v + 1))
        return np.bincount(doc, minlength=len(texts)), add(known.astype(float)).astype(np.int64), add(base), add(np.log10(p))


def fit(texts: DataFrame) -> dict:
    """Count the model of all rows of `texts` (one column, text). What is returned names the parts of its tables.

    Null and empty texts are an end alone. With no rows at all every word is unknown and has probability 1.
    """
    spark = texts.sparkSession
    folder = scratch_dir(spark, "kneser-ney")
    store, source = Store(folder), texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    about = int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // 6 + 1
    word_parts, pair_parts = -(-about // (4 * PART_KEYS)), -(-about // PART_KEYS)

    def word_file(part: int, total: list[np.ndarray]) -> Iterator[tuple]:
        yield part, len(total[0]), int(total[1].sum()), store.put(total[0]), store.put(total[1].astype("<u8"))

    counted = _counted(source, "text", lambda b: tokens(b["text"].to_pylist())[0], lambda h: _part(h, word_parts))
    found = {r[0]: r for r in _by_part(counted, word_parts, 2, word_file, "part long, n long, tokens long, keys string, counts string").collect()}  # one row per part
    empty = store.put(np.zeros(0, "<u8"))
    word_table = [(p, found[p][1], found[p][3], found[p][4]) if p in found else (p, 0, empty, empty) for p in range(word_parts)]
    v, n = sum(w[1] for w in word_table), sum(r[2] for r in found.values())
    if v >= 1 << 32:
        raise ValueError("more words than 32-bit numbers")
    span = -(-(v + 1) // word_parts)  # numbers of words that share a part of the statistics; number v is the start
    loaded: list[Words] = []

    def pair_keys(b: pa.RecordBatch) -> np.ndarray:
        if not loaded:
            loaded.append(Words(store, word_table, n))
        number, _, doc = loaded[0].numbered(b["text"].to_pylist())
        return _pairs(number, doc, v)

    def pair_file(part: int, total: list[np.ndarray]) -> Iterator[tuple]:
        keys, c = total
        of = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        yield 0, part, len(keys), *of, store.put(keys), store.put(c.astype("<u4") if not len(c) or c.max() < 1 << 32 else c), None
        first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        one = np.ones(len(keys), np.uint64)
        zero = np.zeros(len(keys), np.uint64)
        facts = [np.concatenate(x) for x in ((second, first), (one, zero), (zero, c), (zero, (c == 1) * one), (zero, (c == 2) * one), (zero, (c > 2) * one))]
        total = sums(*facts)
        for p, blob in _shares((total[0] // np.uint64(span)).astype(np.int64), *total):
            yield 1, p, 0, 0, 0, 0, 0, None, None, blob

    packed = _counted(source, "text", pair_keys, lambda k: _part(mix(k), pair_parts))
    made = settle(_by_part(packed, pair_parts, 2, pair_file, "kind long, part long, n long, n1 long, n2 long, n3 long, n4 long, keys string, counts string, blob binary"))
    pairs = made.where("kind = 0").drop("kind", "blob").collect()  # one row per part

    def stat_file(part: int, total: list[np.ndarray]) -> Iterator[tuple]:
        dense = np.zeros((5, span), "<u8")
        dense[:, (total[0] - np.uint64(part * span)).astype(np.int64)] = total[1:]
        ahead = dense[0]
        yield part, *(int((ahead == k).sum()) for k in (1, 2, 3, 4)), int((ahead > 2).sum()), store.put(dense)

    stats = _by_part(made.where("kind = 1").select("part", "blob"), word_parts, 6, stat_file, "part long, n1 long, n2 long, n3 long, n4 long, more long, facts string").collect()
    return {
        "folder": folder, "words": word_table, "v": v, "n": n, "span": span, "pair_parts": pair_parts,
        "pairs": [(r["part"], r["n"], r["keys"], r["counts"]) for r in pairs], "stats": [(r["part"], r["facts"]) for r in stats],
        "high": [sum(r[f"n{k}"] for r in pairs) for k in (1, 2, 3, 4)], "low": [sum(r[f"n{k}"] for r in stats) for k in (1, 2, 3, 4)],
        "low_n": [sum(r["n1"] for r in stats), sum(r["n2"] for r in stats), sum(r["more"] for r in stats)], "distinct": sum(r["n"] for r in pairs),
    }


_last: list = [None, None]


def score(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`columns` of `docs`, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every text.

    Null and empty texts are scored as an end alone. Repeated rows have the same score each; null ids stay null.
    Columns of `docs` that are not named are not read. Perplexity is 10 ** (-score / n_tokens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _last[0] != model["folder"]:
            _last[:] = [model["folder"], Scorer(model)]
        for b in slices(batches, "__text", 2 << 20):
            n, known, base, value = _last[1].score(b["__text"].to_pylist())
            yield pa.record_batch([*(b[c] for c in columns), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model["n"], np.int64)), pa.array(base), pa.array(value)], [*columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    rows = docs.select(*columns, docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
