"""A corpus from raw documents: classify, dedup lines, dedup near copies, mix sources, encode.

Each stage takes what the one before kept, as Parquet, and returns documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, cotraining, lines, minhash, mixing
from marketloom.llm.common import table, written
from marketloom.llm.queries import WORD_BPE


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotraining.accepted(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; no document goes here, but copies may be left empty."""
    return _measured(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their targets, a row for each repetition."""
    return _measured(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to."""
    return bpe.encode_documents(docs, WORD_BPE, decoded=False)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mixing", mixture), ("bpe", encode)]

#: A classifier that is trained here and a library's tokenizer are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
