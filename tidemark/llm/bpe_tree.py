"""Byte-level BPE encoding and decoding as a reduction of a monoid.

Encodings of neighbouring byte strings are joined without encoding them again as a whole: the tokens around the seam
are re-encoded, in a window that grows until both of its ends are stable.

Why that is exact. Call a pair of tokens stable if their joined bytes encode to just the two. A sequence in which every
neighbouring pair is stable is the encoding of its bytes: merging takes the pair of lowest rank (leftmost first), so
up to the first merge across a border between two tokens, the bytes of these two change as if they stood alone, and
that merge would also happen there, against the pair's stability. Pairs outside the window were stable before, pairs
inside are neighbours of one encoding, so only the two pairs at the ends of the window have to be looked at.

The same holds one level up for the pattern that splits a text into pieces: it looks at most three characters ahead
and never back, so all pieces of a left half but those near its end stand, and as soon as a piece boundary of the
re-split window falls on one of the right half, all later pieces stand too.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.words import release, slices

#: Byte strings up to this long are merged directly; longer ones are halved.
LEAF_BYTES = 16
#: Texts up to this many characters are split into pieces directly; longer ones are halved.
LEAF_CHARS = 1 << 10
#: So many ids are decoded at once; longer runs are the joined bytes of their halves.
LEAF_IDS = 1 << 10
#: Bytes that the pieces a worker remembers take, about, and pairs of tokens; a memory is emptied when it is full.
MEMO_BYTES, MEMO_PAIRS = 48 << 20, 100_000
#: Stands for a pair that has no rank: above all ranks.
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of Latin-1 characters only, where its classes can be spelled out for the faster `re`."""
    chars = [chr(i) for i in range(256)]
    letters, numbers = ("".join(map(re.escape, filter(lambda c: unicodedata.category(c)[0] == kind, chars))) for kind in "LN")
    spaces = "\t-\r \x85\xa0"
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.DOTALL):
        known = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}.get(part)
        out.append(f"[^{spaces}]" if part == r"\S" and not inside else part if known is None else known if inside else f"[{known}]")
        inside = part == "[" or inside and part != "]"
    return "".join(out)


class Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, piece: str) -> bytes:
        ids = pack("<%dI" % len(found := self.encode(piece.encode("utf-8", "surrogatepass"))), *found)
        if len(piece) <= 64:
            # About 190 bytes for an entry and the heads of its two objects.
            self.held += len(piece) + len(ids) + 190
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self._any, self._latin = ranks, regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo = Memo(self.encode_bytes)
        self.stable: dict[tuple[int, int], bool] = {}
        size = max(self.bytes_of) + 1
        vocabulary = [self.bytes_of.get(i, b"") for i in range(size)]
        self.length = np.array([len(b) for b in vocabulary], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(vocabulary), np.uint8)

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def merge(self, piece: bytes) -> list[int]:
        """The encoding of a byte string, by its definition."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 4 * LEAF_BYTES:
            return self._merge_long(piece)
        n, get = len(piece), ranks.get
        border = list(range(n + 1))  # part i is piece[border[i] : border[i + 1]]
        pairs = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
        while pairs and (best := min(pairs)) is not NONE:
            i = pairs.index(best)
            del pairs[i], border[i + 1]
            if i:
                pairs[i - 1] = get(piece[border[i - 1] : border[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = get(piece[border[i] : border[i + 2]], NONE)
        return [ranks[piece[a:b]] for a, b in zip(border, border[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and a linked list of parts."""
        n, get = len(piece), self.ranks.get
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                prev[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pair_stands(self, a: int, b: int) -> bool:
        if (found := self.stable.get((a, b))) is None:
            if len(self.stable) >= MEMO_PAIRS:
                self.stable.clear()
            found = self.stable[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            l_ok = i == len(left) or self.pair_stands(left[-i - 1], window[0])
            r_ok = j == len(right) or self.pair_stands(window[-1], right[j])
            if l_ok and r_ok:
                return left[: len(left) - i] + window + right[j:]
            i = i if l_ok else min(2 * i, len(left))
            j = j if r_ok else min(2 * j, len(right))

    def encode_bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def pieces(self, text: str) -> list[str]:
        """What the pattern finds in the text, halves first."""
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        tail: list[str] = []
        while left and sum(map(len, tail)) < 4:
            tail.insert(0, left.pop())
        head, k = "".join(tail), 4
        while True:
            window = head + "".join(right[:k])
            found = self.find(window)
            if k >= len(right):
                return left + found
            ends = np.cumsum([len(p) for p in found])
            borders = len(head) + np.cumsum([len(p) for p in right[:k]])
            # The last characters of the window may split otherwise once more text follows.
            met = np.intersect1d(ends[ends <= len(window) - 4], borders)
            if len(met):
                return left + found[: int(np.searchsorted(ends, met[0])) + 1] + right[int(np.searchsorted(borders, met[0])) + 1 :]
            k *= 2

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of all tokens in a row: those of leaves, joined two by two up the tree."""
        parts = [self._leaf(ids[i : i + LEAF_IDS]) for i in range(0, len(ids), LEAF_IDS)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]

    def _leaf(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        total = int(length.sum())
        if not total:
            return b""
        shift = np.repeat(self.begin[ids] - (np.cumsum(length) - length), length)
        return self.flat[shift + np.arange(total)].tobytes()


@functools.lru_cache(maxsize=1)
def _bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def _forget(bpe: ByteBPE) -> None:
    """At the end of a task only the vocabulary stays with the worker."""
    bpe.memo.clear()
    bpe.memo.held = 0
    bpe.stable.clear()
    release()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-level BPE of every text: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    `path` is a file of ranks that every executor has, `pattern` splits texts into pieces that are encoded on their
    own. Null and empty texts have no ids. Rows keep their number; a repeated row gives a repeated result, a null id
    stays null. Other columns of `docs` are not read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in slices(batches, "text"):
            ids = [bpe.encode(t) if t else b"" for t in b["text"].to_pylist()]
            yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})
        _forget(bpe)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of the ids of `encode`: doc_id, n_tokens, ids, decoded (binary). Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in slices(batches, "ids"):
            yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "ids": b["ids"], "decoded": pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b["ids"].to_pylist()], pa.binary())})
        _forget(bpe)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`encode` and then `decode` in one pass: doc_id, n_tokens, ids, decoded. One Python worker holds a row's ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in slices(batches, "text"):
            ids = [bpe.encode(t) if t else b"" for t in b["text"].to_pylist()]
            decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary())})
        _forget(bpe)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
