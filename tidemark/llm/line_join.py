"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Lines are ordered by (doc_id, line number); a line goes if an earlier line, kept or not,
has a Jaccard similarity of at least `similar` with it. Equal sets are one class, held by its first line. A document is
an id and a text: rows that share an id (or have none) but not the text are documents of their own, in the order of a
hash of the text.

Candidates: words of a set are ordered by rarity, and two similar sets share one of their first
``n - ceil(similar * n) + 1`` words. The join on these words keeps a pair only if their sizes (length filter), the places
of the shared word (positional filter, for the first word that both sets share) and the parity bits of the sets allow it:
no more bits differ than words. A set has 64, 128 or 256 such bits by its size, so that the bits of two unlike sets differ in
more places than the words of similar ones may; the longer ones fold into the shorter. What is left is verified on the words
themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import shielded
from tidemark.session import settle

SIMILAR = 0.8
#: Word counts are kept by hash in a table of this fixed size; any order is exact, a rarer-first one is fast.
RARITY_SLOTS = 1 << 20
#: Sets that share a word in larger groups than this are first compared with the earliest of the group.
GROUP = 256
#: Flags by hash that spare most lines the shuffle when the words of candidate lines are fetched.
FLAG_SLOTS = 1 << 20
#: Sets of up to so many words have 64 bits of parity, up to so many 128, larger ones 256.
PARITY = (80, 176)
#: What names a line. part is the hash of the text where an id has several texts, else 0, which takes no space.
LINE = ("doc", "part", "no")
#: Parity of a set, 64 bits each; those that its size does not need are 0.
BITS = ("p0", "p1", "p2", "p3")
#: Stands for a null id in the order.
LOW = -(1 << 63)


def _split(text: Column, lines: bool = False) -> Column:
    """The runs between white space, in lower case, and empty strings; with `lines`, texts may hold line feeds.

    A plain blank is split at without a pattern. In a single line other white space is rare: one search for any of it spares most
    of them the replacements.
    """
    out = F.lower(text)
    plain = out
    for space in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.split(plain if lines else F.when(text.rlike(r"[\t\n\x0B\f\r]"), plain).otherwise(out), " ")


def _words(line: Column) -> Column:
    """Hashes of the words of a line."""
    return F.transform(F.array_remove(_split(line), ""), lambda w: F.xxhash64(w))


def _slot(h: Column, slots: int) -> Column:
    """Slot of a hash in a table of `slots` (a power of two) entries."""
    return h.bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")


def _entry(table: bytes, slot: Column) -> Column:
    """Entry of a table of numbers below 128, one byte each. Its type has no null, so that arrays of entries are sorted as numbers."""
    return F.ascii(F.substring(F.lit(table), slot + 1, F.lit(1)).cast("string"))


def _table(entries: DataFrame, slots: int) -> bytes:
    """Table of the rows (slot, entry), at most one for each slot; they come to the driver as columns, five bytes a row."""
    found, out = entries.select("slot", F.col("entry").cast("tinyint").alias("entry")).toArrow(), np.zeros(slots, np.uint8)
    out[found["slot"].to_numpy()] = found["entry"].to_numpy()
    return out.tobytes()


def _flags(slots: DataFrame) -> bytes:
    """1 for each `slot` of FLAG_SLOTS that occurs."""
    return _table(slots.select("slot").distinct().withColumn("entry", F.lit(1)), FLAG_SLOTS)


def rarity(docs: DataFrame) -> bytes:
    """How common words are, by slot of their hash: four steps per power of two, 0 to 127. Counts all documents."""
    word = F.explode(_split(F.col("text"), lines=True))
    counts = docs.select(word.alias("w")).where("w <> ''").groupBy(_slot(F.xxhash64("w"), RARITY_SLOTS).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return _table(counts.select("slot", F.least(F.floor(F.log2("n") * 4).cast("int"), F.lit(127)).alias("entry")), RARITY_SLOTS)


def _parity(words: Column) -> list[Column]:
    """BITS of a set of hashes: each word turns one bit. Bits 0 to 5 of a hash choose the bit, 6 and 7 the column."""

    def odd(column: int, columns: int) -> Column:
        def turn(acc: Column, h: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
            if columns == 1:
                return acc.bitwiseXOR(bit)
            return F.when(F.shiftright(h, 6).bitwiseAND(F.lit(columns - 1).cast("long")) == column, acc.bitwiseXOR(bit)).otherwise(acc)

        return F.aggregate(words, F.lit(0).cast("long"), turn)

    n, none = F.size(words), F.lit(0).cast("long")
    few, some = n <= PARITY[0], n <= PARITY[1]
    out = [F.when(few, odd(0, 1)).when(some, odd(0, 2)).otherwise(odd(0, 4)), F.when(few, none).when(some, odd(1, 2)).otherwise(odd(1, 4))]
    out += [F.when(some, none).otherwise(odd(i, 4)) for i in (2, 3)]
    return [c.alias(name) for c, name in zip(out, BITS)]


def _sets(lines: DataFrame, table: bytes, similar: float) -> DataFrame:
    """Add n, same (hash of the set), BITS, prefix to rows with a `line`; lines without a word are left out."""
    ranked = F.transform(F.array_distinct(_words(F.col("line"))), lambda h: F.shiftleft(_entry(table, _slot(h, RARITY_SLOTS)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    # Whether there is a word is asked of the line: a filter on the set would build it twice.
    out = lines.where(F.col("line").rlike(r"\S")).withColumn("set", F.sort_array(ranked)).drop("line")
    keep = (F.size("set") - F.ceil(F.size("set") * F.lit(similar) - 1e-9) + 1).cast("int")
    return out.select(*[c for c in out.columns if c != "set"], F.size("set").alias("n"), F.xxhash64("set").alias("same"), *_parity(F.col("set")), F.transform(F.slice("set", F.lit(1), keep), lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")).alias("prefix"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "part", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))


def _may_match(x: str, y: str, similar: float, first: bool = True) -> Column:
    """Length, positional and parity filters for two sets that share a prefix word.

    With `first` only the first shared word of two similar sets has to pass: both prefixes hold it, so one row per pair
    is sure. All other shared words stand behind it, so as many words as must be shared have to be left in either set.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "n") + c(y, "n")
    need = F.ceil(total * (similar / (1 + similar)) - 1e-9)
    length = F.least(c(x, "n"), c(y, "n")) >= F.lit(similar) * F.greatest(c(x, "n"), c(y, "n")) - 1e-9
    before = F.lit(0) if first else F.least(c(x, "at"), c(y, "at"))
    place = before + F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at")) >= need
    p = [c(x, name).bitwiseXOR(c(y, name)) for name in BITS]
    two = p[0].bitwiseXOR(p[2]), p[1].bitwiseXOR(p[3])
    count = lambda columns: sum((F.bit_count(q) for q in columns[1:]), F.bit_count(columns[0]))
    smaller = F.least(c(x, "n"), c(y, "n"))
    differ = F.when(smaller <= PARITY[0], F.bit_count(two[0].bitwiseXOR(two[1]))).when(smaller <= PARITY[1], count(two)).otherwise(count(p))
    return length & place & (differ <= total - 2 * need)


def _pairs(x: str, y: str) -> list[Column]:
    return [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in ((x, "x"), (y, "y")) for c in LINE]


def _earlier(x: str, y: str) -> Column:
    """Whether x stands before y, by plain comparisons: most pairs are told apart by the first."""
    c = lambda side, name: F.col(f"{side}.{name}")
    out = c(x, LINE[-1]) < c(y, LINE[-1])
    for name in reversed(LINE[:-1]):
        out = (c(x, name) < c(y, name)) | ((c(x, name) == c(y, name)) & out)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """The pairs whose sets of words are similar enough."""
    pairs = settle(pairs.distinct())
    end = lambda side: pairs.select(*[F.col(f"{side}_{c}").alias(c) for c in LINE])
    ends = end("x").unionByName(end("y")).distinct()
    slot = _slot(F.xxhash64(*LINE), FLAG_SLOTS)
    lines = _lines(docs).where(_entry(_flags(ends.select(slot.alias("slot"))), slot) == 1)
    sets = settle(lines.join(ends, [*LINE], "left_semi").select(*LINE, F.array_distinct(_words(F.col("line"))).alias("set")))
    x, y = (sets.select(*[F.col(c).alias(f"{side}_{c}") for c in (*LINE, "set")]) for side in "xy")
    both = pairs.join(x, [f"x_{c}" for c in LINE]).join(y, [f"y_{c}" for c in LINE]).withColumn("common", F.size(F.array_intersect("x_set", "y_set")))
    return both.where(F.col("common") >= F.lit(similar) * (F.size("x_set") + F.size("y_set") - F.col("common")) - 1e-9).select(*[f"y_{c}" for c in LINE]).distinct()


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def repeated_by_text(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64), copies, n_lines, removed (ascending line numbers from 0) for every doc_id and text.

    Lines end at a line feed; words are what white space parts, in lower case, as a set. Null and empty texts are one
    line without words; such lines are never removed. Null ids come first in the order. Rows that repeat both doc_id and
    text count as one document, `copies` says how many they are. Where the id is null all copies but one are documents
    that repeat the first: all their words go. Other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LOW)).alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    hashed = rows.withColumn("text_hash", _text_hash(F.col("text")))
    n_lines = F.max(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    ids = settle(hashed.groupBy("doc", "text_hash").agg(n_lines.alias("n_lines"), F.count(F.lit(1)).alias("copies")))
    # Ids of several texts, by slot of their hash; another id of such a slot only takes more space.
    slot = _slot(F.xxhash64("doc"), FLAG_SLOTS)
    flags = _flags(ids.groupBy("doc").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(slot.alias("slot")))
    part = F.when(_entry(flags, slot) == 1, F.col("text_hash")).otherwise(F.lit(0).cast("long")) if any(flags) else F.lit(0).cast("long")
    out = _removed_lines(hashed.select("doc", part.alias("part"), "text"), similar)
    found = ids.withColumn("part", part).join(out, ["doc", "part"], "left")
    return found.select(F.when(F.col("doc") == LOW, F.lit(None)).otherwise(F.col("doc")).cast("long").alias("doc_id"), "text_hash", "copies", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def repeated_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, removed: `repeated_by_text` in one row for every doc_id of `docs`.

    Where an id has several texts (as the null id may), n_lines is that of the longest and removed has the numbers of all
    of them: to change texts, take `repeated_by_text`.
    """
    found = repeated_by_text(docs, similar, id_col, text_col)
    return found.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("removed")))).alias("removed"))


def _removed_lines(rows: DataFrame, similar: float) -> DataFrame:
    """doc, part, removed of the documents (doc, part, text) that lose lines."""
    lines = settle(_sets(_lines(rows), rarity(rows), similar))
    first = F.min(F.struct(*LINE)).alias("first")
    # n, parity and prefix are the same in all lines of a class.
    classes = settle(lines.groupBy("same").agg(first, *[F.first(c).alias(c) for c in ("n", *BITS, "prefix")]))
    rows_of = classes.select(F.posexplode("prefix").alias("at", "word"), *[F.col(f"first.{c}").alias(c) for c in LINE], "n", *BITS)
    crowded = settle(rows_of.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP).select("word"))
    # Before the shuffle, word and place are one number, line number and size another: rows of fewer words.
    low_bits = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")
    pair = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))
    packed = rows_of.join(crowded, "word", "left_anti").select(pair("word", "at").alias("word_at"), "doc", "part", pair("no", "n").alias("no_n"), *BITS)
    near = packed.repartition(F.shiftright("word_at", 32)).select(
        F.shiftright("word_at", 32).alias("word"), low_bits("word_at").alias("at"), "doc", "part", F.shiftright("no_n", 32).cast("int").alias("no"), low_bits("no_n").alias("n"), *BITS
    )
    x, y = near.alias("x"), near.alias("y")
    small = x.join(y, (F.col("x.word") == F.col("y.word")) & _earlier("x", "y") & _may_match("x", "y", similar)).select(*_pairs("x", "y"))
    crowd = settle(rows_of.join(crowded, "word", "left_semi"))
    member = F.struct(*LINE, "n", *BITS, "at")
    heads = crowd.groupBy("word").agg(F.min(member).alias("x"))
    star = crowd.select("word", member.alias("y")).join(heads, "word").where(_may_match("x", "y", similar, first=False) & _earlier("x", "y")).select(*_pairs("x", "y"))
    gone = settle(_verified(small.unionByName(star), rows, similar))
    # In crowded groups, whoever did not match the earliest is compared with all earlier sets; both sides are one shuffle.
    flagged = crowd.join(gone.select(*[F.col(f"y_{c}").alias(c) for c in LINE], F.lit(True).alias("late")), [*LINE], "left").repartition("word")
    x, y = flagged.alias("x"), flagged.where("late is null").alias("y")
    rest = x.join(y, (F.col("x.word") == F.col("y.word")) & _earlier("x", "y") & _may_match("x", "y", similar)).select(*_pairs("x", "y"))
    gone = gone.unionByName(_verified(rest, rows, similar)).distinct()

    named = lines.select(*LINE, "same").join(classes.select("same", "first"), "same")
    held = named.join(gone.select(F.struct(*[F.col(f"y_{c}").alias(c) for c in LINE]).alias("first"), F.lit(True).alias("late")), "first", "left")
    return held.where((F.struct(*LINE) != F.col("first")) | F.col("late")).groupBy("doc", "part").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def without_repeats(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`docs` with texts (and n_chars, where there is such a column) that have lost their repeated lines.

    A document that loses all of its words this way goes; one that had none to begin with stays as it is. Rows without an
    id are documents each, so one of those with equal texts stays; rows that repeat both id and text are changed alike.
    Other columns may have any name.
    """
    inner, restore = shielded(docs, ("doc_id", "text", "n_chars"))
    found = repeated_by_text(inner, similar).where(F.size("removed") > 0).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__gone"))
    copy = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    single = inner.where(~copy).unionByName(inner.where(copy).dropDuplicates(["text"]))
    both = single.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (_text_hash(F.col("text")) == F.col("__hash")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i))
    out = both.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1))).withColumn("text", F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
    out = out.where(F.col("__gone").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return restore(out)
