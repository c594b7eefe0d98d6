"""Ranked lexical search over an index whose documents are grouped by equal length normaliser."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import joined, runs, slices
from tidemark.session import settle

#: Bytes of text in one part of the index, and bytes of search items that one pass over the index serves.
PART_BYTES, BLOCK_BYTES = 8 << 20, 2 << 20
#: Columns of a part: its distinct terms with their document counts, and its documents, strata and postings. Both are packed
#: by Arrow, so that a part is two short values for the JVM and a search for counts reads the first one only.
SCHEMA = "vocabulary binary, postings binary"
VOCABULARY = ("terms", "df")


def _flags() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it belongs to a term, and the byte with A-Z in lower case. Bytes of other than ASCII belong."""
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


def _spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, their term flags, and first and end byte of each term with the text borders kept."""
    buf, at = joined(texts)
    inside = _flags()[0][buf]
    start, end = runs(inside, at)
    return buf, inside, np.stack([start, end]), at


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text number of each term, and the terms as numbers into an array of distinct ones."""
    buf, inside, span, at = _spans(texts)
    doc = np.searchsorted(at, span[0], "right") - 1
    offsets = np.concatenate([[0], np.cumsum(span[1] - span[0])]).astype(np.int64)
    data = _flags()[1][buf[inside]]
    all_terms = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    coded = all_terms.dictionary_encode()
    return doc, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """Parts of an index as a table, the number of documents with a term, and the number of all their terms."""

    parts: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all terms of all documents; it is made without a shuffle.

    Terms are the maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case. A
    first pass counts documents and terms, because the normaliser m = 75 + (25 * n * N) div L needs both. A second pass
    turns every slice of about PART_BYTES of text (a longer text is a slice of its own) into a part: documents in the
    order of (m, doc_id), those of one m being a stratum; within a stratum the postings of a term run by falling tf, so a
    run of equal (stratum, term, tf) lists documents that all get the same impact. Documents without a term, null and
    empty ones among them, are in no part and not counted. Null ids come before others; repeated rows are each kept.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in slices(batches, "text", PART_BYTES):
            _, _, span, at = _spans(b["text"].to_pylist())
            n = np.diff(np.searchsorted(span[0], at))
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.record_batch([pa.array([n_docs]), pa.array([n_terms])], ["n_docs", "n_terms"])

    total = rows.select("text").mapInArrow(sizes, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            part = _part(b["doc_id"], b["text"].to_pylist(), n_docs, n_terms)
            if part is not None:
                yield part

    return Index(settle(rows.mapInArrow(index, SCHEMA)), n_docs, n_terms)


def _part(ids: pa.Array, texts: list[str | None], n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    doc, terms, code = terms_of(texts)
    if not len(doc):
        return None
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    plain = pc.fill_null(ids, 0).to_numpy()
    norm = 75 + (25 * n * n_docs) // n_terms
    order = np.lexsort((plain, known, norm))
    order = order[n[order] > 0]
    place = np.zeros(len(texts), np.int64)
    place[order] = np.arange(len(order))
    norms, first = np.unique(norm[order], return_index=True)
    stratum_of = np.repeat(np.arange(len(norms)), np.diff(np.append(first, len(order))))
    pair, tf = np.unique(place[doc] * len(terms) + code, return_counts=True)
    at, term = pair // len(terms), pair % len(terms)
    stratum = stratum_of[at]
    by = np.lexsort((at, -tf, term, stratum))
    at, term, tf, stratum = at[by], term[by], tf[by], stratum[by]
    head = np.flatnonzero(np.diff(stratum, prepend=-1) | np.diff(term, prepend=-1) | np.diff(tf, prepend=-1))
    lists = [stratum[head], term[head], tf[head], np.append(head[1:], len(at)), at]
    one = lambda a, kind: pa.array([a], pa.list_(kind))
    part = pa.record_batch(
        [
            one(ids.take(pa.array(order)), pa.int64()), one(norms, pa.int32()), one(np.append(first[1:], len(order)), pa.int32()),
            one(terms.cast(pa.binary()), pa.binary()), one(np.bincount(term, minlength=len(terms)), pa.int32()), *[one(a.astype(np.int32), pa.int32()) for a in lists],
        ],
        ["doc_ids", "norms", "norm_docs", "terms", "df", "run_stratum", "run_term", "run_tf", "run_end", "docs"],
    )
    return pack(part)


def pack(part: pa.RecordBatch) -> pa.RecordBatch:
    """A part as one row of SCHEMA."""
    packed = []
    for names in (VOCABULARY, [n for n in part.schema.names if n not in VOCABULARY]):
        some, sink = part.select(list(names)), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(some)
        packed.append(pa.array([sink.getvalue().to_pybytes()], pa.binary()))
    return pa.record_batch(packed, ["vocabulary", "postings"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """Columns of each part, one part at a time."""
    for b in batches:
        for i in range(b.num_rows):
            row = {}
            for c in b.columns:
                with pa.ipc.open_stream(c[i].as_buffer()) as packed:
                    one = packed.read_next_batch()
                row |= {f.name: one.column(f.name)[0].values for f in one.schema}
            yield row


class Best:
    """The `k` best documents of one item so far: highest score, then null id, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.known, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """No document below this score can get in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        score, known, ids = np.append(self.score, score), np.append(self.known, known), np.append(self.id, ids)
        order = np.lexsort((ids, known, -score))[: self.k]
        self.score, self.known, self.id = score[order], known[order], ids[order]


class Part:
    """The runs of one part that belong to any wanted term, with their impacts."""

    def __init__(self, row: dict[str, pa.Array], wanted: pa.Array):
        ints = lambda name: row[name].to_numpy(zero_copy_only=False).astype(np.int64)
        self.norm_docs = np.concatenate([[0], ints("norm_docs")])
        self.known = row["doc_ids"].is_valid().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(row["doc_ids"], 0).to_numpy()
        local = pc.index_in(row["terms"], value_set=wanted)
        number = pc.fill_null(local, -1).to_numpy(zero_copy_only=False).astype(np.int64)[ints("run_term")]
        keep = np.flatnonzero(number >= 0)
        end = ints("run_end")
        begin = np.concatenate([[0], end[:-1]])
        stratum, tf, norm = ints("run_stratum")[keep], ints("run_tf")[keep], ints("norms")
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[stratum])
        # By term, then stratum, then falling tf, as the runs are within a stratum.
        by = np.lexsort((stratum, number[keep]))
        self.term, self.stratum, self.impact = number[keep][by], stratum[by], impact[by]
        self.begin, self.end = begin[keep][by], end[keep][by]
        self.docs = ints("docs")
        #: Where the runs of each wanted term begin.
        self.term_at = np.searchsorted(self.term, np.arange(len(wanted) + 1))
        self.head = np.concatenate([[True], (np.diff(self.term) != 0) | (np.diff(self.stratum) != 0)]) if len(self.term) else np.zeros(0, bool)
        self.total = np.zeros(len(self.ids), np.int64)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Visits strata by falling bound until none can hold a better document; the number of strata visited."""
        size = self.term_at[terms + 1] - self.term_at[terms]
        run = np.repeat(self.term_at[terms] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        if not len(run):
            return 0
        gain, stratum = np.repeat(weight, size) * self.impact[run], self.stratum[run]
        # The first run of a term in a stratum has the greatest tf, so its impact bounds all documents there.
        bound = np.zeros(len(self.norm_docs) - 1, np.int64)
        head = self.head[run]
        np.add.at(bound, stratum[head], gain[head])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done, step = 0, 4
        while done < len(order):
            go = order[done : done + step]
            go = go[bound[go] >= best.least()]
            if not len(go):
                break
            chosen = np.zeros(len(bound), bool)
            chosen[go] = True
            own = np.flatnonzero(chosen[stratum])
            size = self.end[run[own]] - self.begin[run[own]]
            doc = self.docs[np.repeat(self.begin[run[own]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            np.add.at(self.total, doc, np.repeat(gain[own], size))
            seen = np.unique(doc)
            score = self.total[seen]
            self.total[seen] = 0
            good = score >= best.least()
            best.add(score[good], self.known[seen[good]], self.ids[seen[good]])
            done, step = done + len(go), step * 2
        return done


def search(index: Index, items: DataFrame, top: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0, best first.

    The weight of a term is floor(1000 * ln((2N + 2) / (2df + 1))), its part of a score w * ((10**9 * tf) div (1000 * tf +
    12 * m)) for each time it stands in the item; equal scores go by doc_id, nulls first. A part of the index computes the impact
    of each of its runs once, for all items. For an item the bound of a stratum sums the impacts of the greatest tf of its
    terms there; strata are visited by falling bound until the bound is below the last place, which a task keeps from one
    part to the next. A task hands on `top` rows an item whatever it has read.

    Items come in blocks of BLOCK_BYTES, with one pass over the index for each (and one over its terms for df). Items that are null,
    empty or hold no known term give no row; rows that repeat an item_id, or have none, are ranked each on their own.
    """
    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text"))
    spark, out = items.sparkSession, None
    block: list[tuple[int | None, str | None]] = []
    held = 0

    def flush() -> None:
        nonlocal out, block, held
        if block:
            part = settle(_block(index, block, top))
            out = part if out is None else out.unionByName(part)
        block, held = [], 0

    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"] or "") + 64
        if held >= BLOCK_BYTES:
            flush()
    flush()
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(index: Index, block: list[tuple[int | None, str | None]], top: int) -> DataFrame:
    doc, terms, code = terms_of([t for _, t in block])
    wanted = terms.cast(pa.binary())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for row in unpack(batches):
            at = pc.fill_null(pc.index_in(wanted, value_set=row["terms"]), -1).to_numpy(zero_copy_only=False)
            df[at >= 0] += row["df"].to_numpy(zero_copy_only=False)[at[at >= 0]]
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["term", "df"])

    counted = index.parts.select("vocabulary").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # at most one row per term of the block
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(wanted))], np.int64)
    begin = np.searchsorted(doc, np.arange(len(block) + 1))
    asked = []
    for i, (item_id, _) in enumerate(block):
        own, times = np.unique(code[begin[i] : begin[i + 1]], return_counts=True)
        use = weight[own] > 0
        asked.append((i, item_id, own[use], (weight[own] * times)[use]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked]
        for row in unpack(batches):
            part = Part(row, wanted)
            for (_, _, own, value), b in zip(asked, best):
                part.search(own, value, b)
        names = ["no", "item_id", "score", "doc_id"]
        for (i, item_id, _, _), b in zip(asked, best):
            if len(b.score):
                k = len(b.score)
                yield pa.record_batch([pa.array([i] * k, pa.int32()), pa.array([item_id] * k, pa.int64()), pa.array(b.score), pa.array(b.id, mask=~b.known)], names)

    found = index.parts.mapInArrow(run, "no int, item_id long, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH words AS (SELECT rid, doc_id, unnest(t) AS term FROM (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
post AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
doc AS (SELECT rid, sum(tf)::BIGINT AS n FROM post GROUP BY rid),
stat AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM doc),
norm AS MATERIALIZED (SELECT rid, 75 + (25 * n * nn) // ll AS m FROM doc, stat),
weight AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, stat GROUP BY term),
item AS (SELECT no, item_id, unnest(t) AS term FROM (
  SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
asked AS (SELECT no, item_id, term, count(*) AS k FROM item GROUP BY ALL),
scored AS (
  SELECT no, item_id, rid, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN norm USING (rid) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
