"""Token ids as files of canonical, length-limited Huffman codes.

1. ``encode_ids``   every text to ids, with the end id.
2. ``codebook``     code lengths from the counts of all ids (package-merge; the table is as large as the vocabulary).
3. ``write_file``   documents in ascending order of doc_id, in independent blocks.
4. ``read_file``    blocks decoded by table lookup, all checkpoints of a batch side by side.

The file format is a folder of three Parquet tables: ``codebook`` (id, length), ``starts`` (bucket, start: ids of all
documents of earlier buckets) and ``blocks`` (bucket, block, payload). The order is that of (bucket, block). A payload
holds, in little-endian order: the header ``magic, documents, ids, checkpoints, bits`` (5 x uint64), the document ids
(int64), flags of null ids (uint8), the ids in each document (int64), the bit offset of each checkpoint (uint64, one
for every ``STEP`` ids), and the codes, first bit highest, filled up to whole 32-bit words plus one. Each payload can
be decoded with nothing but the code lengths, from any of its checkpoints on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import joined, not_space, runs, slices
from tidemark.session import scratch_dir

MAGIC = 0x314655484D4454
#: Ids from one checkpoint to the next, and the ids after which a block is closed. A document never spans two blocks.
STEP, BLOCK_IDS = 256, 1 << 17
#: Longest code in bits; a table of 2 ** LONGEST entries decodes. It must reach log2 of the vocabulary.
LONGEST = 18
#: Documents of about so many ids share a range of doc_id, which one task sorts and writes.
BUCKET_IDS = 4_000_000
#: Bytes of words and ids that a worker remembers from slice to slice and task to task.
MEMO_BYTES = 48 << 20
#: Bytes of text worked on at a time.
TEXT_BYTES = 8 << 20
#: Small letters of Latin-1 and a mark behind them: the library's normal form leaves them alone and splits off the mark.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,]?)").fullmatch
#: Characters that Python takes for white space and tokenizers do not.
ODD_SPACE = tuple("\x1c\x1d\x1e\x1f")


class Words:
    """Ids of whole texts, from the library's ids of their words.

    The tokenizer of the given file splits at white space and drops it, and its normal forms don't reach across it, so
    a text has the ids of its words (runs of other than space and control characters 9 to 13) in a row. A text with
    characters on whose nature views differ, or with a string that the library takes for an added token, is given to the
    library whole. The library lowers letters and parts a full stop or comma from the letters before it, so these are
    taken off a word of ASCII letters first, which leaves fewer distinct words.

    A slice of texts is split at once: its distinct words are looked up, only new ones are tokenized, and ids are
    gathered by array operations. Memory holds the ids of all words in one array. When it is full, words that no other
    slice has asked for since go, and all do if that leaves more than half.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content] + [c.encode() for c in ODD_SPACE]
        self._forget()
        #: Bytes of an id: two, if the vocabulary allows it.
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.mark = dict(zip(["", ".", ","], [[], *self._library([".", ","])]))
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: What stands in the vocabulary for the bytes of those letters.
        self.visible = {b: seen for c in map(chr, range(0xDF, 0x100)) if PLAIN(c) for b, seen in zip(c.encode(), split(c)[0][0], strict=True)}

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.asked = np.zeros(1 << 16, np.uint8)
        self.held = 0

    def _tidy(self) -> None:
        """Forget words that only one slice has asked for since the last time."""
        asked = self.asked[: len(self.number)]
        keep = np.flatnonzero(asked > 1)
        words = [w for w, again in zip(self.number, (asked > 1).tolist()) if again]  # in the order of their entries
        size, begin, flat = self.size[keep], self.begin[keep], self.flat
        self._forget()
        if 2 * self._bytes(words, int(size.sum())) <= MEMO_BYTES:
            at = np.cumsum(size) - size
            self._store(words, flat[np.repeat(begin - at, size) + np.arange(int(size.sum()))], size)
            self.asked[: len(words)] = 1

    def _bytes(self, words: list[bytes], ids: int) -> int:
        # About 100 bytes for an entry of the dictionary and its places.
        return sum(map(len, words)) + 4 * ids + 100 * len(words)

    def _store(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.number)
        self.flat = _grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin, self.size, self.asked = (_grown(a, n + len(words)) for a in (self.begin, self.size, self.asked))
        self.begin[n : n + len(words)], self.size[n : n + len(words)] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + len(words))))
        self.held += self._bytes(words, len(ids))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words. Plain ones skip the steps of the library that would leave them as they are."""
        tokenize, found, odd = self.tokenizer.model.tokenize, [], []
        for w in words:
            if w.isalpha() and len(w) < 64:  # ASCII letters, in lower case already
                found.append([x.id for x in tokenize(w.decode())])
                continue
            t = w.decode("utf-8", "surrogatepass")
            if len(t) < 64 and (m := PLAIN(t.lower())):
                found.append([x.id for x in tokenize(m[1].encode().decode("latin-1").translate(self.visible))] + self.mark[m[2]])
            else:
                odd.append(len(found))
                found.append(t)
        for i, ids in zip(odd, self._library([found[i] for i in odd])):
            found[i] = ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._store(words, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size)

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, `end` behind each, and the number of each text's ids."""
        if self.held > MEMO_BYTES:
            self._tidy()
        buf, at = joined(texts)
        whole = buf.tobytes()
        odd = []
        if any(s in whole for s in self.special):
            odd = [i for i, t in enumerate(texts) if t and any(s in whole[at[i] : at[i + 1]] for s in self.special)]
        inside = not_space()[buf]
        for i in odd:
            inside[at[i] : at[i + 1]] = False
        start, stop = runs(inside, at)
        # A last byte that is a full stop or comma behind ASCII letters only is a word of its own.
        other = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
        np.cumsum(~self.letter[buf], out=other[1:])
        last = buf[stop - 1] if len(stop) else np.zeros(0, np.uint8)
        marked = np.flatnonzero(((last == 46) | (last == 44)) & (stop - start > 1) & (other[stop] - other[start] == 1))
        start, stop = np.insert(start, marked + 1, stop[marked] - 1), np.insert(stop, marked, stop[marked] - 1)
        doc = np.searchsorted(at, start, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(self.lower[buf[inside]])]).dictionary_encode()
        distinct = _values(coded.dictionary)
        new = [w for w in distinct if w not in self.number]
        if new:
            self._learn(new)
        entry = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        self.asked[entry] = np.minimum(self.asked[entry], 1) + 1
        word = entry[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        begin, size = self.begin[word], self.size[word]
        count = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64) + 1
        late = dict(zip(odd, self._library([texts[i] for i in odd]))) if odd else {}
        for i, ids in late.items():
            count[i] = len(ids) + 1
        upto = np.cumsum(count)
        out = np.empty(int(upto[-1]) if len(upto) else 0, self.kind)
        out[upto - 1] = end
        # Each word's ids go behind those of the words before it; a text's first word goes where the text begins.
        run = np.cumsum(size) - size
        first = np.searchsorted(doc, np.arange(len(texts)))
        ahead = np.append(run, int(size.sum()))[first]
        to = run - ahead[doc] + (upto - count)[doc]
        # Bounded by the slice, so places fit 32 bits unless one text is longer than that.
        place = np.int32 if len(out) < 1 << 31 and self.used < 1 << 31 else np.int64
        step = np.arange(int(size.sum()), dtype=place)
        out[np.repeat((to - run).astype(place), size) + step] = self.flat[np.repeat((begin - run).astype(place), size) + step]
        for i, ids in late.items():
            out[upto[i] - count[i] : upto[i] - 1] = ids
        return out, count


_loaded: dict[str, Words] = {}


def _words(path: str) -> Words:
    """The words of a worker, which stay when a task ends: the next one meets mostly the same."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Words(path)
    return _loaded[path]


def _values(a: pa.LargeBinaryArray) -> list[bytes]:
    """All values of a column without nulls that begins at its buffers' first byte."""
    if not len(a):
        return []
    at = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1].tolist()
    whole = a.buffers()[2].to_pybytes()
    return [whole[i:j] for i, j in pairwise(at)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def encode_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text followed by `end_id`: doc_id, n_tokens, ids (binary, little-endian unsigned integers of 16
    bits, or of 32 if the vocabulary is larger than that).

    Ids are those of the library for the whole text, added tokens included where their strings occur. Null and empty
    texts have the end id alone. Repeated rows and null ids stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for b in slices(batches, "text", TEXT_BYTES):
            ids, count = words.encode(b["text"].to_pylist(), end_id)
            at = np.concatenate([[0], np.cumsum(words.kind.itemsize * count)])
            kind, width = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
            packed = pa.Array.from_buffers(kind, len(count), [None, pa.py_buffer(at.astype(width)), pa.py_buffer(ids)])
            yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array(count), "ids": packed.cast(pa.binary())})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, count over all rows of `encode_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches, "ids", TEXT_BYTES):
            ids = b"".join(x.as_buffer() for x in b["ids"])
            part = np.bincount(np.frombuffer(ids, _kind(len(ids), pc.sum(b["n_tokens"]).as_py() or 0)))
            total = _grown(total, len(part))
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return encoded.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _kind(size: int, ids: int) -> str:
    """The integers of so many bytes that hold so many ids."""
    return "<u4" if size == 4 * ids else "<u2"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code none of whose codes is longer than `longest` bits (package-merge)."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    own = np.asarray(counts, np.int64)[order]
    levels, row = [], own
    is_leaf = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(is_leaf)
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, packs])
        rank = np.argsort(both, kind="stable")
        row, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ids with given lengths: codes ascend with (length, id)."""

    def __init__(self, ids: Iterable[int], lengths: Iterable[int]):
        ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        span = np.left_shift(1, LONGEST - lengths)
        first = np.cumsum(span) - span
        size = int(ids.max()) + 1 if len(ids) else 1
        self.length, self.code = np.zeros(size, np.int32), np.zeros(size, np.uint64)
        self.length[ids], self.code[ids] = lengths, (first >> (LONGEST - lengths)).astype(np.uint64)
        self.table = np.full(1 << LONGEST, 1, np.int32)  # id * 32 + length
        self.table[: int(span.sum())] = np.repeat(ids * 32 + lengths, span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The codes of the ids as bytes, the bit offset of every STEP-th id, and the number of bits."""
        length = self.length.take(ids)
        end = np.cumsum(length, dtype=np.int64)
        start, bits = end - length, int(end[-1])
        word = start >> 5
        value = self.code.take(ids) << (64 - (start & 31) - length).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros((bits >> 5) + 3, np.uint64)
        out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] |= np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[: (bits + 31 >> 5) + 1].astype(">u4").tobytes(), start[::STEP], bits

    def unpack(self, parts: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of several blocks (bytes, checkpoints, number of ids), one step of all their checkpoints at a time."""
        at = np.cumsum([0] + [len(p[0]) for p in parts])
        data = np.frombuffer(b"".join(p[0] for p in parts) + bytes(4), np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        bit = np.concatenate([p[1].astype(np.int64) + 8 * a for p, a in zip(parts, at)])
        left = np.concatenate([np.minimum(STEP, p[2] - STEP * np.arange(len(p[1]))) for p in parts])
        order = np.argsort(-left, kind="stable")
        bit, left = bit[order], left[order]
        live = np.searchsorted(-left, -np.arange(STEP), "left").tolist()
        out, mask = np.zeros((STEP, len(bit)), np.uint32), np.uint32((1 << LONGEST) - 1)
        for k, n in enumerate(live):
            if not n:
                break
            b = bit[:n]
            shift = (32 - LONGEST - (b & 7)).astype(np.uint32)
            found = self.table.take(window.take(b >> 3) >> shift & mask)
            out[k, :n] = found >> 5
            b += found & 31
        back = np.empty((len(bit), STEP), np.uint32)
        back[order] = out.T
        rows = np.cumsum([0] + [len(p[1]) for p in parts])
        return [back[a:b].reshape(-1)[: p[2]] for p, a, b in zip(parts, rows, rows[1:])]


def _payload(code: Code, ids: list[np.ndarray], docs: list[int | None]) -> bytes:
    all_ids = np.concatenate(ids)
    body, points, bits = code.pack(all_ids)
    head = np.array([MAGIC, len(ids), len(all_ids), len(points), bits], "<u8").tobytes()
    named = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + bytes(d is None for d in docs)
    return head + named + np.array([len(x) for x in ids], "<i8").tobytes() + points.astype("<u8").tobytes() + body


def _parse(payload: bytes) -> tuple[list[int | None], np.ndarray, tuple[bytes, np.ndarray, int]]:
    magic, n, total, points, _ = (int(x) for x in np.frombuffer(payload, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a block of Huffman codes")
    at = 40
    docs, at = np.frombuffer(payload, "<i8", n, at), at + 8 * n
    null, at = payload[at : at + n], at + n
    lengths, at = np.frombuffer(payload, "<i8", n, at), at + 8 * n
    marks, at = np.frombuffer(payload, "<u8", points, at), at + 8 * points
    return [None if gone else int(d) for d, gone in zip(docs, null)], lengths, (payload[at:], marks, total)


def write_file(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize all documents and write them to `folder` (format above), in ascending order of doc_id.

    Rows of equal doc_id are ordered by the crc32 of their ids; null doc_ids come first. Buckets are ranges of (doc_id,
    crc32, place in the spool), so that rows that share an id, or have none, are spread as well. An empty table gives
    empty files.
    """
    spark = docs.sparkSession
    spool = scratch_dir(spark, "ids")
    encode_ids(docs, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(spool)
    encoded = spark.read.parquet(spool)
    counts = id_counts(encoded).toPandas().sort_values("id")  # at most the vocabulary
    lengths = code_lengths(counts["n"].to_numpy())
    book = pd.DataFrame({"id": counts["id"].astype("int64"), "length": lengths.astype("int64")})
    spark.createDataFrame(book, "id long, length long").coalesce(1).write.parquet(f"{folder}/codebook")
    code = Code(book["id"], book["length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, ids, names, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([block], pa.int64()), "payload": pa.array([_payload(code, ids, names)], pa.binary())})

        for b in batches:
            for own, doc, n, x in zip(b["bucket"].to_pylist(), b["doc_id"].to_pylist(), b["n_tokens"].to_pylist(), b["ids"]):
                if held >= BLOCK_IDS:
                    yield close()
                    block, ids, names, held = block + 1, [], [], 0
                bucket = own
                ids.append(np.frombuffer(x.as_buffer(), _kind(len(x.as_buffer()), n)))
                names.append(doc)
                held += len(ids[-1])
        if ids:
            yield close()

    ranges = max(1, math.ceil(int(counts["n"].sum()) / BUCKET_IDS))
    order = [F.asc_nulls_first("doc_id"), F.asc("crc"), F.asc("place")]
    keyed = encoded.select("doc_id", "n_tokens", "ids", F.crc32("ids").alias("crc"), F.monotonically_increasing_id().alias("place"))
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("bucket"), "doc_id", "n_tokens", "ids")
    ranged.mapInArrow(run, "bucket int, block long, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    sums = _heads(spark.read.parquet(f"{folder}/blocks")).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().sort_values("bucket")  # one row per BUCKET_IDS ids
    sums["start"] = sums["n"].cumsum() - sums["n"]
    spark.createDataFrame(sums[["bucket", "start"]].astype({"bucket": "int32", "start": "int64"}), "bucket int, start long").coalesce(1).write.parquet(f"{folder}/starts")


def _heads(blocks: DataFrame) -> DataFrame:
    """bucket, block, n: the number of ids stands in the header of a block."""
    return blocks.select("bucket", "block", _uint32(F.col("payload"), 17).alias("n"))


def read_file(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Documents of a folder of `write_file`, decoded: doc_id, start, n_tokens, ids_crc32, ids.

    `start` counts the ids of all documents before; `ids` are little-endian unsigned 32-bit integers and `ids_crc32`
    is their unsigned crc32. ``keep_ids=False`` leaves the ids themselves out.
    """
    book = spark.read.parquet(f"{folder}/codebook").toPandas()  # at most the vocabulary
    code = Code(book["id"], book["length"])
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload", 1 << 21):
            parsed = [_parse(x) for x in b["payload"].to_pylist()]
            decoded = code.unpack([p[2] for p in parsed])
            for (docs, lengths, _), bucket, block, ids in zip(parsed, b["bucket"].to_pylist(), b["block"].to_pylist(), decoded):
                end = np.cumsum(lengths)
                texts = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(end, lengths)]
                columns = {
                    "bucket": pa.array([bucket] * len(docs), pa.int32()), "block": pa.array([block] * len(docs), pa.int64()), "doc_id": pa.array(docs, pa.int64()),
                    "offset": pa.array(end - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "crc": pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                }
                yield pa.record_batch(columns | ({"ids": pa.array(texts, pa.binary())} if keep_ids else {}))

    # The window runs over the few blocks of one bucket.
    heads = _heads(blocks)
    earlier = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("start")
    starts = heads.join(spark.read.parquet(f"{folder}/starts"), "bucket").select("bucket", "block", base.alias("base"))
    rows = blocks.mapInArrow(run, "bucket int, block long, doc_id long, offset long, n_tokens long, crc long, ids binary" if keep_ids else "bucket int, block long, doc_id long, offset long, n_tokens long, crc long")
    out = rows.join(starts, ["bucket", "block"])
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"), *(["ids"] if keep_ids else []))


def _uint32(payload: Column, at: int) -> Column:
    """The low half of the little-endian integer that begins at a byte (the first is 1)."""
    return sum(F.ascii(F.decode(F.substring(payload, at + i, 1), "ISO-8859-1")).cast("long") * F.lit(256**i) for i in range(4))
