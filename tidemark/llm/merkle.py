"""Document fingerprints as Merkle trees, in column expressions only.

A document is cut into paragraphs (lines), a paragraph into sentences, a sentence of more than 512 characters behind
words that say so (32 characters at least and 256 at most, so a text without any border has bounded leaves too). These
pieces are the leaves; a paragraph's digest is that of its leaves in a row, a section's that of its paragraphs, the root
that of the sections. A section ends behind a paragraph whose digest says so (one in four), so an edit moves section
borders near itself only.

A fingerprint is the written tree: ``root|s{p(lll)p(ll)}s{...}`` with 64 hex digits of the root (sha256), 12 of a section
or paragraph, and of each leaf 10 and its length in 3. Roots test equality; where they differ, equal branches are
skipped on the way down. Likeness is the share of characters in equal leaves, told from the written leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents whose ids share so many high bits meet in one window to find their successor.
RANGE_BITS = 8
#: A space behind the end of a sentence.
SENTENCE = r"(?<=[.!?]) "
#: Longest sentence in characters that is a leaf as a whole, and the pieces of a longer one.
LONGEST = 512
PIECE = r"(?s).{32,254}?[a-dA-D\x{0400}-\x{043F}] |.{1,256}"


def tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`_fp (fingerprint) and `out`_leaves (its leaves in order) of a non-null text column.

    The empty text is one paragraph with one empty leaf. A text without line ends is one paragraph however long.
    """
    leaves, paras, starts, sections = (f"__{out}_{x}" for x in ("leaves", "paras", "starts", "sections"))
    pieces = lambda x: F.when(F.char_length(x) > LONGEST, F.regexp_extract_all(x, F.lit(PIECE), 0)).otherwise(F.array(x))
    leaf = lambda x: F.concat(F.md5(x.cast("binary")), F.lpad(F.lower(F.hex(F.char_length(x))), 3, "0"))
    df = df.withColumn(leaves, F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.flatten(F.transform(F.split(p, SENTENCE, -1), pieces)), leaf)))
    df = df.withColumn(paras, F.transform(leaves, lambda x: F.md5(F.array_join(x, "").cast("binary"))))
    ends = lambda i: F.substring(F.element_at(paras, i), 1, 1) < "4"  # noqa: E731  the digest of the i-th paragraph
    df = df.withColumn(starts, F.filter(F.sequence(F.lit(1), F.size(paras)), lambda i: (i == 1) | ends(F.greatest(i - 1, F.lit(1)))))
    stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(paras) + 1)
    df = df.withColumn(sections, F.transform(starts, lambda i, k: F.md5(F.array_join(F.slice(paras, i, stop(k) - i), "").cast("binary"))))
    brief = lambda d: F.concat(F.substring(d, 1, 10), F.substring(d, 33, 3))  # noqa: E731  a leaf as it is written
    short = lambda x: F.array_join(F.transform(x, brief), "")
    para = lambda i: F.concat(F.substring(F.element_at(paras, i), 1, 12), F.lit("("), short(F.element_at(leaves, i)), F.lit(")"))
    written = F.transform(starts, lambda i, k: F.concat(F.substring(F.get(sections, k), 1, 12), F.lit("{"), F.array_join(F.transform(F.sequence(i, stop(k) - 1), para), ""), F.lit("}")))
    df = df.withColumn(f"{out}_fp", F.concat(F.sha2(F.array_join(sections, "").cast("binary"), 256), F.lit("|"), F.array_join(written, "")))
    return df.withColumn(f"{out}_leaves", F.transform(F.flatten(leaves), brief)).drop(leaves, paras, starts, sections)


def _weight(leaves: Column) -> Column:
    """Characters in written leaves, and one for each."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, d: n + 1 + F.conv(F.substring(d, 11, 3), 16, 10).cast("long"))


def likeness(a: str | Column, b: str | Column, a_fp: str | Column, b_fp: str | Column) -> Column:
    """Share of characters in equal leaves of two trees (Dice coefficient of the distinct leaves by length), 0 to 1; 1 where the roots are equal."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    a, b = col(a), col(b)
    same = F.substring(col(a_fp), 1, 64) == F.substring(col(b_fp), 1, 64)
    # Two texts can have the same leaves in another order; that is less than equal.
    near = 2 * _weight(F.array_intersect(a, b)) / (_weight(F.array_distinct(a)) + _weight(F.array_distinct(b)))
    return F.when(same, F.lit(1.0)).otherwise(F.least(near, F.lit(1.0 - 1e-9)))


def first_difference(a: str, b: str) -> Column:
    """Number of leaves (in order) before the first that differs; the count of leaves of the shorter tree if none does."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, n)


def with_next(docs: DataFrame) -> DataFrame:
    """Add `next`: the text of the following document by doc_id (then text), of the last one that of the first.

    Documents of a small range of ids are sorted in one task. So that the last of a range sees its successor, the first
    document of each range is also sent to the range before; the list of ranges is linked up the same way, on ranges
    of ranges, so nothing is ordered as a whole.
    """
    low = F.lit(-(1 << 63)).cast("long")
    keyed = docs.withColumn("__id", F.coalesce("doc_id", low)).withColumn("__range", F.shiftright("__id", RANGE_BITS)).withColumn("__tie", F.sha2(F.col("text").cast("binary"), 256))
    ranges = keyed.select("__range").distinct()
    coarse = ranges.select(F.shiftright("__range", 16).alias("__far")).distinct()
    far_before = F.lag("__far").over(Window.orderBy("__far"))  # one row per 2 ** (RANGE_BITS + 16) ids
    links = ranges.withColumn("__far", F.shiftright("__range", 16)).withColumn("__before", F.lag("__range").over(Window.partitionBy("__far").orderBy("__range")))
    ends = links.groupBy("__far").agg(F.max("__range").alias("__top"), F.min("__range").alias("__bottom"))
    chain = coarse.withColumn("__prior", far_before).join(ends.select(F.col("__far").alias("__prior"), "__top"), "__prior", "left").select("__far", "__top")
    last = ends.agg(F.max("__top").alias("__last"))
    links = links.join(chain, "__far", "left").crossJoin(F.broadcast(last)).select("__range", F.coalesce("__before", "__top", "__last").alias("__to"))
    heads = keyed.groupBy("__range").agg(F.min(F.struct("__id", "__tie", "text")).alias("h")).join(links, "__range")
    copies = heads.select(F.col("__to").alias("__range"), F.lit(1).alias("__late"), F.col("h.__id").alias("__id"), F.col("h.__tie").alias("__tie"), F.col("h.text").alias("text"))
    own = keyed.select("__range", F.lit(0).alias("__late"), "__id", "__tie", "doc_id", "text")
    both = own.unionByName(copies.withColumn("doc_id", F.lit(None).cast("long")))
    # The copy of a range's successor sorts behind all of the range's own documents, also for the last range of all.
    following = F.lead("text").over(Window.partitionBy("__range").orderBy("__late", "__id", "__tie"))
    return both.withColumn("next", following).where("__late = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_leaf for every text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. `edit_leaf` counts the leaves before the first that the edit changed. Null counts as empty; null ids
    come first; rows that repeat an id are ordered by the digest of their texts. A single row is its own successor.
    Equal texts have equal fingerprints. Other columns of `docs` are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    cut = with_next(rows).withColumn("n", F.char_length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n") - F.col("half")).cast("int")), F.substr("next", F.lit(1), F.col("half")))
    t = tree(tree(tree(cut.withColumn("edited", edited), "text", "own"), "edited", "edited"), "next", "next")
    return t.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("own_fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"), likeness("own_leaves", "edited_leaves", "own_fp", "edited_fp").alias("near_edited"),
        likeness("own_leaves", "next_leaves", "own_fp", "next_fp").alias("near_next"), first_difference("own_leaves", "edited_leaves").alias("edit_leaf"),
    )
