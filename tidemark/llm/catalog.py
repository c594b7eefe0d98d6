"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bag_minhash, ball_codes, bpe_tree, byte_cnn, flow_mix, huffman_ids, jump_shards, kneser_ney, line_join, merkle, mincut_html, strata_search, string_tiling
from tidemark.session import scratch_dir

#: Vocabulary files and the splitting pattern; operators take them as parameters.
BYTE_RANKS, PATTERN, WORD_TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json"), 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return mincut_html.extract(_table(spark, sf_dir, "pages"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    model = byte_cnn.fit(docs.where(byte_cnn.fold("doc_id", 4) != 2))
    return byte_cnn.predict(docs, model).select("doc_id", (byte_cnn.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards."""
    return jump_shards.shard(_table(spark, sf_dir, "documents"), 8)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the passage."""
    return string_tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short=True)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near duplicates of every document."""
    return bag_minhash.groups(_table(spark, sf_dir, "documents"))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, read back from the files they were written to."""
    folder = scratch_dir(spark, "huffman")
    huffman_ids.write_file(_table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID, folder)
    return huffman_ids.read_file(spark, folder, keep_ids=False)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the folds other than 2 of 7."""
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs.where(byte_cnn.fold("doc_id", 7) != 2).select("text"))
    return kneser_ney.score(docs, model).withColumn("held_out", byte_cnn.fold("doc_id", 7) == 2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat or nearly repeat an earlier line."""
    return line_join.repeated_by_text(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    both = bpe_tree.round_trip(_table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every usable vector."""
    return ball_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return strata_search.search(strata_search.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), 20)


def op13_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    docs = _table(spark, sf_dir, "documents")
    taken = flow_mix.mix(docs, F.array(docs["source"]), flow_mix.repeating((1, 2, 3)), most=3)
    return taken.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_merkle_fingerprints, op3_language_id, op4_jump_shards, op5_decontamination, op6_near_duplicates, op7_huffman_ids, op8_kneser_ney, op9_line_dedup, op10_byte_bpe, op11_ball_codes, op12_strata_search,
        op13_flow_mix,
    )
}
SQL: dict[str, str] = {"op4_jump_shards": jump_shards.SQL, "op11_ball_codes": ball_codes.SQL, "op12_strata_search": strata_search.SQL, "op13_flow_mix": flow_mix.SQL}
