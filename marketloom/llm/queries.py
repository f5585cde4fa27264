"""The registered queries of this package, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import bpe, compression, cotraining, language, lines, lloyd, minhash, mixing, projections, secrets, sstable, trie, vafile
from marketloom.llm.common import table

#: Public vocabularies, at the same place on every machine.
WORD_BPE, PIECES = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
END_ID = 2


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def op5_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op8_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), WORD_BPE, END_ID))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs, PIECES))


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compress(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_source_mixing, op4_va_file_top_k, op5_co_training_quality, op6_compression_bands, op7_secret_scan, op8_sstable_tokens, op9_bpe_round_trip, op10_language_id, op11_filtering_lloyd, op12_conversation_trie, op13_projection_neighbours)}


def oracle_sql() -> dict[str, str]:
    oracle = f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) AS mixed"
    return {"op1_line_dedup": lines.ORACLE, "op3_source_mixing": oracle, "op4_va_file_top_k": vafile.ORACLE, "op11_filtering_lloyd": lloyd.ORACLE, "op12_conversation_trie": trie.ORACLE}
