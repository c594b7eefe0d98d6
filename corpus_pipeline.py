"""A corpus pipeline in five stages; each works on what the one before has kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bag_minhash, bpe_tree, byte_cnn, line_join, string_tiling
from tidemark.llm.catalog import BYTE_RANKS, PATTERN
from tidemark.llm.words import shielded
from tidemark.session import scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds no language go; the others carry the language that it names."""
    model = byte_cnn.fit(docs.where(byte_cnn.fold("doc_id", 4) != 2))
    inner, restore = shielded(docs, ("text", "lang"))
    named = byte_cnn.predict(inner, model, tuple(inner.columns)).where("lang_pred <> 'und'")
    return restore(named.withColumn("lang", F.col("lang_pred")) if "lang" in docs.columns else named)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go; a document that loses all its words this way goes."""
    return line_join.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return bag_minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; rows that share a doc_id, or have none, are told apart by their texts."""
    inner, restore = shielded(docs, ("doc_id", "text"))
    found = string_tiling.contaminated(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hashed=True)
    gone = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = inner["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (string_tiling.text_hash(inner["text"]) == F.col("__hash"))
    return restore(inner.join(gone, same, "left_anti"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the bytes they decode to."""
    return bpe_tree.round_trip(docs, BYTE_RANKS, PATTERN).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL has no term for a trained network or a tokenizer; tests compare the rows of every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
