"""Sharding by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import index_rows

#: Fixed values of the published algorithm: multiplier of its generator, and two to the powers it works with.
FACTOR, WORD, HIGH, LOW = 2862933555777941757, 1 << 64, 1 << 33, 1 << 31


def jump(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among `shards`. With one shard more, a key keeps its shard or goes to the new one.

    The key passes a chain of random jumps to ever higher shards; the last one below `shards` is its place. The chain
    has at most `shards` links, one more than ln(shards) on average. Arithmetic modulo 2 ** 64 is done in decimals,
    which hold the product of two 64-bit integers. A null key counts as 0.
    """
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    signed = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    start = F.struct(F.when(signed < 0, (signed + whole(WORD)).cast("decimal(20,0)")).otherwise(signed).alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def leap(s: Column, _: Column) -> Column:
        turned = ((s["key"] * F.lit(Decimal(FACTOR)).cast("decimal(19,0)") + F.lit(1)) % whole(WORD)).cast("decimal(20,0)")
        # The new key is needed twice, so it is bound to a name by a one-element array.
        go = F.transform(F.array(turned), lambda k: F.struct(
            k.alias("key"), s["next"].alias("at"),
            F.floor((s["next"] + 1).cast("double") * (F.lit(float(LOW)) / (F.floor(k / whole(HIGH)).cast("double") + 1))).cast("long").alias("next"),
        ))[0]
        return F.when(s["next"] < shards, go).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, leap, lambda s: s["at"].cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the law is `key`, doc_id and `shards` decide alone.

    `grown_shard` is the shard with one shard more; rows only ever move into the new one. Slots count the rows of a
    shard from 0 in the order of doc_id without gaps; positions come from counts of small ranges of doc_id, so no task
    sorts a whole shard. Null texts have size 1 and the crc32 of no bytes. Null ids come first and are keyed as 0. Rows
    that repeat an id share its shard and take a slot each. Other columns of `docs` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sized = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sized.withColumn("shard", jump(F.col("doc_id"), shards)).withColumn("grown_shard", jump(F.col("doc_id"), shards + 1))
    known = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    at = index_rows(placed, ["shard"], [F.shiftright(known, 24), F.shiftright(known, 10)], [F.asc_nulls_first("doc_id"), "text_crc32", "size"])
    return at.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rn") - 1).cast("long").alias("slot"), "grown_shard")


SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),
chain AS (
  SELECT doc_id, n, CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k, -1::BIGINT AS at_, 0::BIGINT AS nx
  FROM ids, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, nx, floor((nx + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM chain WHERE nx < n)
),
home AS (SELECT doc_id, max(at_) FILTER (n = 8) AS shard, max(at_) FILTER (n = 9) AS grown FROM chain GROUP BY doc_id),
digits AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
byte_list AS (
  SELECT doc_id, size, CASE WHEN size = 1 THEN []::BIGINT[] ELSE list_transform(range(1, 2 * size - 1, 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT) END AS b
  FROM digits
),
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)
  )
),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) AS text_crc32
  FROM byte_list, crc_table
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, h.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY h.shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot, h.grown::INTEGER AS grown_shard
FROM summed s JOIN home h ON s.doc_id IS NOT DISTINCT FROM h.doc_id
"""
