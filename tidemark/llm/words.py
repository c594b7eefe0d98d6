"""Words of many texts at once: NumPy passes over the joined bytes of an Arrow batch instead of loops over rows."""

from __future__ import annotations

import ctypes
import functools
import gc
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at a time, so that the tables of powers stay small whatever the length of a text.
BLOCK = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _up_to(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, for exponents below n."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def joined(texts: Iterable[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text begins (one entry more than texts). Null is empty."""
    parts = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def runs(inside: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of each run of set flags; a run never reaches over the border of two texts, nor over a
    position that `cut` flags as the first of a new run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < n]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] |= inside[tails]
    if cut is not None:
        first |= inside & cut
        last[:-1] |= inside[:-1] & cut[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK)))
        s, e = start[i], end[j - 1]
        up, down = _up_to(int(e - s) + 1)
        prefix = np.zeros(int(e - s) + 1, np.uint64)
        np.cumsum((buf[s:e].astype(np.uint64) + np.uint64(1)) * up[: e - s], out=prefix[1:])
        a, b = start[i:j] - s, end[i:j] - s
        out[i:j] = (prefix[b] - prefix[a]) * down[a] ^ (b - a).astype(np.uint64) << np.uint64(40)
        i = j
    return mix(out)


#: Scripts written without blanks between words (first and last character of each block).
UNSEGMENTED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16F00, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x33FFF),
)
#: Kinds of characters; marks go with the character before them.
LETTER, MARK, SINGLE, SINGLE_MARK = 1, 2, 3, 4


@functools.cache
def _kinds() -> np.ndarray:
    """Kind by code point: 0 where no word goes on. Above the last entry there are no letters."""
    names = [unicodedata.category(chr(c)) for c in range(0x34000)]
    kinds = np.array([LETTER if n[0] in "LN" else MARK if n in ("Mn", "Mc") else 0 for n in names], np.uint8)
    kinds[0xFE00:0xFE10] = 0  # these choose between shapes of a character
    for a, b in UNSEGMENTED:
        own = kinds[a : b + 1]
        own[[k == LETTER and n not in ("Nd", "No") for k, n in zip(own, names[a : b + 1])]] = SINGLE
        own[own == MARK] = SINGLE_MARK
    return kinds


def letter_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first and end byte of each word of UTF-8 texts: runs of letters, digits and their marks, and
    single characters of scripts without blanks between words."""
    ascii_flags = np.zeros(256, bool)
    ascii_flags[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    inside = ascii_flags[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    first = buf[lead]
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = first.astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | buf[lead[more] + k] & 0x3F
    table = _kinds()
    kind = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 0)
    for k in range(4):
        inside[lead[(size > k) & (kind > 0)] + k] = True
    # A single character is a word with the marks behind it: words are cut before it and after them.
    cut = np.zeros(len(buf) + 1, bool)
    cut[(lead + size)[kind >= SINGLE]] = True
    cut[lead[(kind == MARK) | (kind == SINGLE_MARK)]] = False
    cut[lead[kind == SINGLE]] = True
    start, end = runs(inside, at, cut[:-1])
    return hashes(buf, start, end), np.searchsorted(at, start, "right") - 1, start, end


def not_space() -> np.ndarray:
    """Flags by byte: all but space and the control characters 9 to 13."""
    flags = np.ones(256, bool)
    flags[[32, *range(9, 14)]] = False
    return flags


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words of one text, and the number of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * BASE + h[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(g[at]), at


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about `most` bytes of `column`; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, i = np.cumsum(size), 0
        while i < batch.num_rows:
            base = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def release() -> None:
    """Give memory that is no longer used back to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def shielded(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but `names` under names that no operator uses, and what gives back names and order."""
    away = {c: c if c in names else f"__kept{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[docs[c].alias(n) for c, n in away.items()])
    return inner, lambda out: out.select(*[out[n].alias(c) for c, n in away.items()])
