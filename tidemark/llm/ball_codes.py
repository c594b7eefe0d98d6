"""Vector code compression: product codes whose codebooks are refined by ball k-means on exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: Vectors worked on at a time, which bounds the tables of distances.
SLICE = 4096
#: Components beyond this (after scaling) would not leave room for squared distances in 64 bits.
LIMIT = 1 << 27


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector is there and all its components are finite numbers within the range of the integers."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * scale).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance, by trying all entries; ties go to the lower index."""
    d = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - book[None, :, j]
        d += step * step
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def again(x: np.ndarray, code: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry after the entries have moved, from the former codes; the last value counts distances worked out.

    An entry's ball holds the rows coded with it; its radius is the greatest distance r of these rows from the moved
    entry. Only entries at most 2r away are its neighbours. Of a row at distance p, an entry more than 2p away from
    the own one is further than p by the triangle inequality. So rows with 2p below the distance of the nearest
    neighbour (the stable core) keep their code untried, and the others, in the ring between the halves of the k-th and
    the next neighbour's distance, try the first k neighbours. Squares are compared, so this is exact; entries exactly
    2p away are tried, because a tie may go to a lower index.
    """
    own = x - book[code]
    best = (own * own).sum(1)
    gap = np.zeros((len(book), len(book)), np.int64)
    for j in range(book.shape[1]):
        step = book[:, j, None] - book[None, :, j]
        gap += step * step
    np.fill_diagonal(gap, np.iinfo(np.int64).max)
    order = np.argsort(gap, 1, kind="stable")[:, : len(book) - 1]
    far = np.take_along_axis(gap, order, 1)
    if not far.shape[1]:
        return code, best, len(x)
    radius = np.zeros(len(book), np.int64)
    np.maximum.at(radius, code, best)
    neighbours = (far <= 4 * radius[:, None]).sum(1)
    out, at = code.copy(), best.copy()
    ring = np.flatnonzero((neighbours[code] > 0) & (far[code, 0] <= 4 * best))
    most = int(neighbours.max(initial=0))
    tries = (far[code[ring], :most] <= 4 * best[ring, None]).sum(1)
    tried = len(x) + int(tries.sum())
    for k in range(int(tries.max(initial=0))):
        left = tries > k
        ring, tries = ring[left], tries[left]
        other = order[code[ring], k]
        step = x[ring] - book[other]
        d = (step * step).sum(1)
        win = (d < at[ring]) | ((d == at[ring]) & (other < out[ring]))
        out[ring[win]], at[ring[win]] = other[win], d[win]
    return out, at, tried


def assign(x: np.ndarray, codes: np.ndarray | None, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances of integer vectors after each of `books` in turn."""
    n, parts = len(x), books[0].shape[0]
    cut = x.reshape(n, parts, -1)
    out, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        code, d = (None, None) if codes is None else (codes[:, p].astype(np.int64), None)
        for book in books:
            code, d = nearest(cut[:, p], book[p]) if code is None else again(cut[:, p], code, book[p])[:2]
        out[:, p], error[:, p] = code, d
    return out, error


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    """Integer vectors of a batch."""
    return np.frombuffer(b"".join(b["ints"].to_pylist()), "<i4").reshape(b.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _moved(table: DataFrame, books: list[np.ndarray]) -> np.ndarray:
    """The next codebooks: floored means of the parts of each entry under the last of `books`; unused entries stay.

    A task sends one row per part, entry and component, whatever the number of its vectors; the driver gets one row for
    each in all.
    """
    parts, entries, width = books[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in _pieces(batches):
            x = _vectors(b).astype(np.int64)
            codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, parts)
            if len(books) > 1:
                codes, _ = assign(x, codes, books[1:])
            cut = x.reshape(len(x), parts, width)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], cut[:, p])
        at = np.flatnonzero(np.repeat(count.ravel() > 0, width))
        yield pa.record_batch([pa.array(at), pa.array(np.repeat(count.ravel(), width)[at]), pa.array(total.ravel()[at])], ["place", "n", "total"])

    sums = table.select("ints", "code").mapInArrow(run, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = books[-1].copy().ravel()
    for r in sums.collect():  # at most one row per component of the codebooks
        moved[r["place"]] = r["total"] // r["n"]
    return moved.reshape(parts, entries, width)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Components become floor(scale * x); vectors are cut into `parts` equal parts, each with a codebook of `entries`
    entries (at most 256), which starts as the parts of the smallest vec_ids (nulls last, equal ids by their vectors) and
    moves to floored means `rounds` times. The first assignment tries all entries, every later one only those that ball
    k-means leaves (`again`); results are the same as by trying all. Codes are two hex digits a part; `error` sums the
    final squared distances, `label_error` the errors of equal labels, nulls together.

    Vectors that are null, empty or hold a null, infinite or not-a-number component are left out; so are components beyond
    2**27 after scaling. All vectors need one length, a multiple of `parts`: those of another length than the first codebook
    row are left out as well. Fewer vectors than `entries` give smaller codebooks; an empty table gives no rows. Repeated
    rows are each kept, other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    kept = rows.where(usable(F.col("v"), scale))
    # A fixed number of rows: the sort keeps no more than `entries` in each task.
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not first or len(first[0]) % parts:
        if first:
            raise ValueError(f"vectors of {len(first[0])} components can't be cut into {parts} equal parts")
        return spark.createDataFrame([], schema).select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    dim = len(first[0])
    start = whole(np.array([v for v in first if len(v) == dim], np.float64), scale)
    books = [np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x = whole(b["v"].flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim)
            codes, _ = assign(x, None, books[:1])
            packed = pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())
            yield pa.record_batch([b["vec_id"], b["label"], pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), packed], ["vec_id", "label", "ints", "code"])

    kind = rows.schema["label"].dataType.simpleString()
    table = settle(kept.where(F.size("v") == dim).mapInArrow(code, f"vec_id long, label {kind}, ints binary, code binary"))
    for _ in range(rounds):
        books.append(_moved(table, books))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x = _vectors(b).astype(np.int64)
            former = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(x), parts)
            codes, error = assign(x, former, books[1:]) if rounds else assign(x, None, books)
            text = pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)])
            yield pa.record_batch([b["vec_id"], b["label"], text, pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    done = settle(table.mapInArrow(finish, schema))
    by_label = done.groupBy(F.col("label").alias("__label")).agg(F.sum("error").cast("long").alias("label_error"))
    return done.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books[-1])).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """Assignment under codebook n - 1 and the codebook that follows from it."""
    return f"""
dist{n} AS MATERIALIZED (
  SELECT x.rid, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
  FROM cut x JOIN book{n - 1} b USING (p)
),
best{n} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM dist{n} GROUP BY rid, p),
mean{n} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT x.p, a.e, unnest(range(len(x.v))) AS i, unnest(x.v) AS c FROM cut x JOIN best{n} a USING (rid, p)) GROUP BY p, e, i
  ) GROUP BY p, e
),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{n - 1} b LEFT JOIN mean{n} m USING (p, e))"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM (SELECT rid, unnest(range(16)) AS p, v FROM kept)),
book0 AS MATERIALIZED (SELECT p, rid AS e, v FROM cut WHERE rid < 64),{_round(1)},{_round(2)},{_round(3)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM best3 GROUP BY rid),
hashed AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), hashed
"""
