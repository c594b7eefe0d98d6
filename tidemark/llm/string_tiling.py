"""Benchmark passages in documents by greedy string tiling, which also finds them in another order.

Runs of ``SEED`` words that a document shares with a test item are the seeds. Where the seeds of an item could cover
enough of it, the longest common runs are marked, longest first and never overlapping, until none of SEED words is
left; runs are searched for by running Karp-Rabin: hashes of all unmarked windows of a length that falls from long to
short. A document is contaminated if its tiles cover `threshold` of the words of an item.

The test items are the stated query set: they go through the documents in blocks of bounded size, each block one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import grams, joined, letter_words, slices
from tidemark.session import settle

#: Words of a seed, and of the shortest tile.
SEED = 5
#: Share of an item's words that tiles must cover.
COVER = 0.6
#: Bytes of test items that are held and sent to the tasks at a time.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, coverage double, words int, tiles array<struct<item_from: int, doc_from: int, words: int>>"


class Items:
    """The words of a block of test items and a sorted index of their seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        buf, at = joined(texts, lower=True)
        h, item, _, _ = letter_words(buf, at)
        self.ids, self.words = ids, h
        self.first = np.searchsorted(item, np.arange(len(ids) + 1))
        g, place = grams(h, item, SEED)
        order = np.argsort(g, kind="stable")
        self.place = place[order]  # word numbers, by seed
        self.seeds, self.run = np.unique(g[order], return_index=True)
        self.run = np.append(self.run, len(g))
        # Items of fewer words, by their number: hashes of the whole in order, and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SEED):
            own = np.flatnonzero(np.diff(self.first) == n)
            if len(own):
                g, place = grams(h, item, n)
                whole = g[np.searchsorted(place, self.first[own])]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], own[order]

    def length(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])


def tile(item: np.ndarray, text: np.ndarray, free: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words); `free` flags the words of the text that may be matched."""
    item_free, text_free, tiles = np.ones(len(item), bool), free.copy(), []
    length = max(least, len(item))
    while True:
        found = _matches(item, text, item_free, text_free, length)
        longest = max((n for n, _, _ in found), default=0)
        if longest >= 2 * length:
            length = longest
            continue
        # Only the longest are marked (of equal ones the first in the item, then in the text): a match that they cut is
        # found again at its new length and takes its turn.
        for n, i, j in sorted(m for m in found if m[0] == longest):
            if item_free[i : i + n].all() and text_free[j : j + n].all():
                tiles.append((i, j, n))
                item_free[i : i + n] = text_free[j : j + n] = False
        if found:
            continue
        if length == least:
            return sorted(tiles)
        length = max(least, length // 2)


def _windows(h: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a length that are wholly free, and where they begin."""
    if len(h) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[length:] == taken[:-length])
    g, place = grams(h, np.zeros(len(h), np.int64), length)
    return g[at], place[at]


def _matches(item: np.ndarray, text: np.ndarray, item_free: np.ndarray, text_free: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """The longest free common run through each common window of `length` words that begins a run."""
    a, at = _windows(item, item_free, length)
    b, bt = _windows(text, text_free, length)
    both = np.intersect1d(a, b)
    if not len(both):
        return []
    where: dict[int, list[int]] = {}
    for g, i in zip(a.tolist(), at.tolist()):
        where.setdefault(g, []).append(i)
    hit = np.isin(b, both)
    out, seen = [], {}
    for g, j in zip(b[hit].tolist(), bt[hit].tolist()):
        for i in where.get(g, ()):
            if seen.get(j - i, -1) > j:  # inside the run found before on the same diagonal
                continue
            n, most = length, min(len(item) - i, len(text) - j)
            while n < most and item[i + n] == text[j + n] and item_free[i + n] and text_free[j + n]:
                n += 1
            if np.array_equal(item[i : i + n], text[j : j + n]):
                out.append((n, i, j))
                seen[j - i] = j + n - length + 1
    return out


def _whole(items: Items, h: np.ndarray, doc: np.ndarray, begins: np.ndarray, ids: list[int | None]) -> Iterator[tuple]:
    """Rows of SCHEMA for the texts that hold an item of fewer than SEED words, at its first place."""
    for n, (whole, own) in items.short.items():
        g, place = grams(h, doc, n)
        low, high = np.searchsorted(whole, g), np.searchsorted(whole, g, "right")
        hit = np.flatnonzero(high > low)
        low, high = low[hit], high[hit]
        item = own[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))]
        here = np.repeat(place[hit], high - low)
        pairs, at = np.unique(doc[here] * len(items.ids) + item, return_index=True)
        for pair, j in zip(pairs.tolist(), here[at].tolist()):
            d, i = divmod(pair, len(items.ids))
            if np.array_equal(h[j : j + n], items.words[items.first[i] : items.first[i] + n]):
                yield ids[d], items.ids[i], 1.0, n, [{"item_from": 0, "doc_from": j - int(begins[d]), "words": n}]


def find(items: Items, ids: list[int | None], texts: list[str | None], threshold: float, short: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA for the texts whose tiles reach the threshold, and if `short` for those that hold an item too short for tiles."""
    buf, at = joined(texts, lower=True)
    h, doc, _, _ = letter_words(buf, at)
    begins = np.searchsorted(doc, np.arange(len(texts) + 1))
    if short:
        yield from _whole(items, h, doc, begins, ids)
    g, place = grams(h, doc, SEED)
    if not len(items.seeds) or not len(g):
        return
    spot = np.minimum(np.searchsorted(items.seeds, g), len(items.seeds) - 1)
    hit = np.flatnonzero(items.seeds[spot] == g)
    low, high = items.run[spot[hit]], items.run[spot[hit] + 1]
    word = items.place[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))]
    item = np.searchsorted(items.first, word, "right") - 1
    here = np.repeat(place[hit], high - low)
    row = doc[here]
    order = np.lexsort((here, item, row))
    row, item, word, here = row[order], item[order], word[order], here[order]
    edge = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(item, prepend=-1).astype(bool))
    for a, b in zip(edge, [*edge[1:], len(row)]):
        d, i = int(row[a]), int(item[a])
        first, n = int(items.first[i]), items.length(i)
        need = threshold * n
        reach = np.zeros(n + 1, np.int64)
        own = np.unique(word[a:b]) - first
        np.add.at(reach, own, 1)
        np.add.at(reach, np.minimum(own + SEED, n), -1)
        if (np.cumsum(reach[:-1]) > 0).sum() < need:
            continue
        lo, hi = int(begins[d]), int(begins[d + 1])
        # Only words inside shared seeds can be in a tile; the text between them is cut to one taken word.
        inside = np.zeros(hi - lo + SEED, bool)
        for k in range(SEED):
            inside[here[a:b] - lo + k] = True
        inside = inside[: hi - lo]
        keep = inside | np.concatenate([[False], inside[:-1]])
        where = np.flatnonzero(keep)
        tiles = tile(items.words[first : first + n], h[lo:hi][where], inside[where])
        covered = sum(t[2] for t in tiles)
        if covered >= need:
            yield ids[d], items.ids[i], covered / n, n, [{"item_from": x, "doc_from": int(where[y]), "words": w} for x, y, w in tiles]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVER, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short: bool = False, hashed: bool = False) -> DataFrame:
    """Pairs of a document and a test item it contains: doc_id, item_id, coverage, words (of the item), tiles; if `hashed`, also
    text_hash (xxhash64 of the text), which tells rows apart that share a doc_id.

    Words are runs of letters and digits in lower case, and single characters of scripts without blanks between words.
    Null and empty texts hold nothing and give no row. Items shorter than SEED words can't be told from chance; if `short`,
    they are found where a document holds all their words in a row, else they give no row. Repeated documents or items give a row each; a
    null id stays null; other columns are not read. An empty table on either side gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *([text_hash(docs[text_col]).alias("text_hash")] if hashed else []))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))

    def one(ids: list, texts: list) -> DataFrame:
        block = Items(ids, texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "coverage", "words", "tiles"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("item_from", pa.int32()), ("doc_from", pa.int32()), ("words", pa.int32())]))]
            for b in slices(batches, "text"):
                # Rows go by their place in the slice, so that each finds its id and hash again.
                found = list(find(block, list(range(b.num_rows)), b["text"].to_pylist(), threshold, short))
                at = pa.array([f[0] for f in found], pa.int64())
                out = [b["doc_id"].take(at), *(pa.array([f[k] for f in found], kinds[k]) for k in range(1, len(kinds)))]
                yield pa.record_batch([*out, b["text_hash"].take(at)], [*names, "text_hash"]) if hashed else pa.record_batch(out, names)

        return rows.mapInArrow(run, SCHEMA + (", text_hash long" if hashed else ""))

    done, ids, texts, held = None, [], [], 0
    for r in items.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"] or "") + 64
        if held >= BLOCK_BYTES:
            part = settle(one(ids, texts))
            done = part if done is None else done.unionByName(part)
            ids, texts, held = [], [], 0
    if done is None or ids:
        part = one(ids, texts)
        done = part if done is None else done.unionByName(part)
    return done
