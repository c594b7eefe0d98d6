"""Near-duplicate groups by BagMinHash signatures, banding and an exact check of the multisets.

A document is the multiset of its runs of five words. Its signature is drawn from Poisson processes over (time, weight):
the weight axis is cut into the ranges (0,1], (1,2], (2,4], (4,8], ... with a process each, and a range that a weight
covers in part is halved, its first point going to one half and the other half going on from there. Components of the
signature keep their first point below the weight, and two documents agree in a component with a probability equal
to their weighted Jaccard similarity. Points later than all components have seen are never drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import BASE, grams, joined, letter_words, mix, shielded, slices
from tidemark.session import settle

SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 1.2e-5, one of 0.85 with 4e-8.
BANDS, ROWS = 48, 7
#: Two bits of each component go along with a candidate, in so many 64-bit words.
WORDS = -(-BANDS * ROWS // 32)
#: Candidates whose bits agree in fewer components than a similar pair would, by this many standard deviations, are not
#: verified: a pair at the threshold is lost with a probability of 3e-6.
SIGMAS = 4.5
#: 64-bit words of parity: each shingle turns one bit, so that bags differ in at least as many shingles as in bits.
PARITY = 16


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words, and their text, in order of both. A text of fewer words is one run."""
    buf, at = joined(texts, lower=True)
    h, doc, _, _ = letter_words(buf, at)
    g, place = grams(h, doc, SHINGLE)
    row = doc[place]
    count = np.bincount(doc, minlength=len(texts))
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        a = int(np.searchsorted(doc, i))
        whole = np.array([count[i]], np.uint64)
        for x in h[a : a + count[i]]:
            whole = mix(whole * BASE + x)
        g, row = np.append(g, whole), np.append(row, i)
    order = np.lexsort((g, row))
    return g[order], row[order]


def weights(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) of sorted shingles and how often each occurs."""
    first = np.flatnonzero((np.diff(g, prepend=g[:1] ^ np.uint64(1)) != 0) | (np.diff(row, prepend=-1) != 0))
    return g[first], row[first], np.diff(np.append(first, len(g)))


def parities(g: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """Parity words (texts, PARITY) of sorted shingles; the first, second, ... occurrence of a shingle are told apart."""
    first = np.flatnonzero((np.diff(g, prepend=g[:1] ^ np.uint64(1)) != 0) | (np.diff(row, prepend=-1) != 0))
    nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    place = mix(g + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(64 * PARITY)
    odd = np.bincount(row * 64 * PARITY + place.astype(np.int64), minlength=texts * 64 * PARITY) & 1
    return np.packbits(odd.astype(bool).reshape(texts, -1), axis=1).view(np.int64)


def _wait(key: np.ndarray, i: np.ndarray | int) -> np.ndarray:
    """The i-th exponential waiting time of a process."""
    bits = mix(key + np.uint64(0x632BE59BD9B4E019) * np.asarray(i, np.uint64))
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)


def _node(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + high.astype(np.uint64)))


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts, size) of multisets given as distinct (hash, text) with whole weights; 0 for empty ones."""
    time, point = np.full(texts * size, np.inf), np.zeros(texts * size, np.uint64)
    lows, highs = [0], [1]
    while highs[-1] < (weight.max() if len(weight) else 0):
        lows.append(highs[-1])
        highs.append(2 * highs[-1])
    parts = []
    for a, b in zip(lows, highs):
        e = np.flatnonzero(weight > a)
        low, high = np.full(len(e), a), np.full(len(e), b)
        key = _node(h[e], low, high)
        parts.append((e, low, high, key, _wait(key, 0) / ((b - a) * size)))
    e, low, high, key, x = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in zip(*parts)) if parts else ([],) * 5
    seq = np.zeros(len(e), np.uint64)
    burst = 1
    while len(e):
        latest = time.reshape(texts, size).max(1)
        on = x < latest[row[e]]
        e, low, high, key, x, seq = e[on], low[on], high[on], key[on], x[on], seq[on]
        wide = high - low > 1
        # Ranges of weight one give their points, a burst of them at a time; those past the latest change nothing.
        i = np.flatnonzero(~wide)
        if len(i):
            more = seq[i][:, None] + np.arange(1, burst + 1, dtype=np.uint64)
            ahead = x[i][:, None] + np.cumsum(_wait(key[i][:, None], more), 1) / size
            at_time = np.concatenate([x[i][:, None], ahead[:, :-1]], 1).ravel()
            name = mix(key[i][:, None] ^ mix((more - np.uint64(1)) + np.uint64(1 << 40))).ravel()
            cell = np.repeat(row[e[i]], burst) * size + (name % np.uint64(size)).astype(np.int64)
            better = at_time < time[cell]
            at_time, name, cell = at_time[better], name[better], cell[better]
            np.minimum.at(time, cell, at_time)
            won = time[cell] == at_time
            point[cell[won]] = name[won] | np.uint64(1)
            x[i], seq[i] = ahead[:, -1], seq[i] + np.uint64(burst)
        # Wider ones are halved: the point stays in one half, the other half waits for its own.
        j = np.flatnonzero(wide)
        if len(j):
            mid = (low[j] + high[j]) // 2
            right = (mix(key[j] + np.uint64(7)) >> np.uint64(63)).astype(bool)
            halves = []
            for is_right, a, b in ((False, low[j], mid), (True, mid, high[j])):
                used = a < weight[e[j]]
                k = _node(h[e[j]], a, b)
                t = np.where(right == is_right, x[j], x[j] + _wait(k, 0) / ((b - a) * size))
                halves.append([v[used] for v in (e[j], a, b, k, t, np.zeros(len(j), np.uint64))])
            kept = [v[i] for v in (e, low, high, key, x, seq)]
            e, low, high, key, x, seq = (np.concatenate(v) for v in zip(kept, *halves))
        burst = min(2 * burst, 64)
    return point.reshape(texts, size)


def _same(text: Column) -> Column:
    """128-bit hash of a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (shingles), same (128-bit hash of the text), bands (array of band hashes, empty without words), bits (two
    bits of each component) and parity (``parities``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            g, row = shingles(b["text"].to_pylist())
            flat = signatures(*weights(g, row), b.num_rows)
            sig = flat.reshape(b.num_rows, BANDS, ROWS)
            two = np.zeros((b.num_rows, 32 * WORDS), np.uint64)
            two[:, : flat.shape[1]] = flat >> np.uint64(62)
            bits = (two.reshape(b.num_rows, WORDS, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(2, dtype=np.uint64)
            band = mix(np.full(sig.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))
            for k in range(ROWS):
                band = mix(band * BASE + sig[:, :, k])
            n = np.bincount(row, minlength=b.num_rows)
            bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32), band[n > 0].view(np.int64).ravel())
            yield pa.record_batch({"doc_id": b["doc_id"], "n": pa.array(n, pa.int64()), "same": b["same"], "bands": bands, "bits": pa.FixedSizeListArray.from_arrays(bits.view(np.int64).ravel(), WORDS).cast(pa.list_(pa.int64())), "parity": pa.FixedSizeListArray.from_arrays(parities(g, row, b.num_rows).ravel(), PARITY).cast(pa.list_(pa.int64()))})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), _same(docs[text_col]).alias("same"))
    return rows.mapInArrow(run, "doc_id long, n long, same binary, bands array<long>, bits array<long>, parity array<long>")


def _may_be_similar(x: str, y: str, similar: float) -> Column:
    """Shingle counts, parity and signature bits allow the similarity. Similar bags differ in few shingles, so in no more
    bits of parity; that is exact and sharp for short texts. A signature component that differs has equal bits in one of
    four cases."""
    count = F.least(f"{x}.n", f"{y}.n") >= F.lit(similar) * F.greatest(f"{x}.n", f"{y}.n")
    odd = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(PARITY)), F.lit(0))
    count &= odd <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * F.lit((1 - similar) / (1 + similar)) + 1e-6
    turned = [F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")) for i in range(WORDS)]
    low = F.lit(0x5555555555555555)
    differ = sum((F.bit_count(t.bitwiseOR(F.shiftrightunsigned(t, 1)).bitwiseAND(low)) for t in turned), F.lit(0))
    size, share = BANDS * ROWS, 0.75 * (1 - similar)
    return count & (differ <= F.lit(size * share + SIGMAS * (size * share * (1 - share)) ** 0.5))


def _bags(texts: DataFrame) -> DataFrame:
    """id and the sorted shingle hashes (binary) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            g, row = shingles(b["text"].to_pylist())
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.record_batch({"id": b["id"], "bag": pa.array([g[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())})

    return texts.mapInArrow(run, "id long, bag binary")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    # An element that occurs p and q times is a run of p + q; its common part is found from the runs of either side.
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[i], cb[j]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _verify(pairs: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose multisets are at least `similar`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similar for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield pa.record_batch({"a": batch["a"].filter(pa.array(ok)), "b": batch["b"].filter(pa.array(ok))})

    left = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a")
    both = left.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id, copies: one row per row of `docs`; the group is named by its smallest doc_id.

    Documents belong together if a chain of links joins them; a link is an equal text, or multisets of five-word runs
    (words: runs of letters and digits in lower case, single characters of scripts without blanks) with a weighted Jaccard similarity of at least `similar`. A text
    of fewer than five words is one run of its words; null and empty texts are equal to each other and linked to
    nothing else. `copies` counts the rows of equal text. Rows that repeat a doc_id are one document if the texts are
    equal, else documents of their own that go by the same name, and a null id is grouped by its text alone. Other columns are not read.

    Equal texts are settled first and one of each goes on. In every bucket of a band the first document is compared
    with all others (a star, not pairs) and the links give components. Then documents of one bucket but of different
    components are compared; the join that brings them together drops those whose counts, parity and signature bits rule
    the similarity out, and the rest is verified on the multisets.
    """
    return _grouped(docs, similar, id_col, text_col).select("doc_id", "group_id", "copies")


def _grouped(docs: DataFrame, similar: float, id_col: str, text_col: str) -> DataFrame:
    """`groups` with same (hash of the text) and stays: whether this text is the first of its group by (doc_id, same)."""
    drawn = settle(sketch(docs, id_col, text_col))
    equal = settle(drawn.groupBy("same").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")))
    # A text is a node named by its doc_id; where texts share that, all but the first have a hash of both for a name.
    shared = equal.groupBy("head").agg(F.min("same").alias("least"), F.count(F.lit(1)).alias("texts")).where("texts > 1 and head is not null").select("head", "least")
    equal = settle(equal.join(shared, "head", "left").select("same", "head", "copies", F.when(F.col("least") != F.col("same"), F.xxhash64("head", "same")).otherwise(F.col("head")).alias("id")))
    heads = equal.where("head is not null").select(F.col("head").alias("doc_id"), "same", "id")
    firsts = drawn.where(F.size("bands") > 0).join(heads, ["doc_id", "same"])
    keyed = firsts.select("id", F.explode("bands").alias("key"))
    # Only keys with two documents matter; the rows of a key meet in a join that can be split.
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("center")).where("rows > 1")
    members = settle(keyed.join(shared, "key").select("key", "id", "center"))
    nodes = heads.join(members.select("id").distinct(), "id", "left_semi")
    facts = settle(drawn.join(nodes, ["doc_id", "same"]).select("id", "n", *[F.col("bits")[i].alias(f"b{i}") for i in range(WORDS)], *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)]).dropDuplicates(["id"]))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), _same(docs[text_col]).alias("same"), docs[text_col].cast("string").alias("text"))
    bags = settle(_bags(texts.join(nodes, ["doc_id", "same"]).select("id", "text")).dropDuplicates(["id"]))

    star = members.where("id <> center").select("id", "center").distinct()
    x, y = facts.alias("x"), facts.alias("y")
    near = star.join(x, F.col("center") == F.col("x.id")).join(y, star["id"] == F.col("y.id")).where(_may_be_similar("x", "y", similar))
    links = settle(_verify(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), bags, similar))
    comp = settle(components(links))
    # Buckets that hold one component are done; the others keep all documents but the center, which has met them all. A
    # quarter of the buckets goes first: what it links need not meet in the others.
    for part in (F.pmod("key", F.lit(4)) == 0, F.pmod("key", F.lit(4)) != 0):
        named = members.where("id <> center").where(part).select("key", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        left = named.join(mixed, "key").join(facts, "id")
        x, y = left.alias("x"), left.alias("y")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & _may_be_similar("x", "y", similar))
        fresh = settle(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        more = settle(_verify(fresh, bags, similar))
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = settle(components(links))

    named = equal.join(comp, "id", "left")
    first = named.where("comp is not null").groupBy("comp").agg(F.min(F.struct("head", "same")).alias("first"))
    named = named.join(first, "comp", "left").select("same", "copies", F.coalesce("first.head", "head").alias("group_id"), F.coalesce(F.col("first.same") == F.col("same"), F.lit(True)).alias("stays"))
    return drawn.select("doc_id", "same").join(named, "same")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the document with the smallest doc_id stays, once.

    Rows without an id can't be named as a duplicate and stay as they are; rows that repeat both id and text count once. Other
    columns may have any name.
    """
    inner, restore = shielded(docs, ("doc_id", "text"))
    found = _grouped(inner, similar, "doc_id", "text")
    stay = found.where("stays and doc_id = group_id").select("doc_id", F.col("same").alias("__same")).distinct()
    once = inner.withColumn("__same", _same(inner["text"])).join(stay, ["doc_id", "__same"], "left_semi").dropDuplicates(["doc_id", "__same"]).drop("__same")
    return restore(once.unionByName(inner.where("doc_id is null")))
