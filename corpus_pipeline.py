"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input. The tables that
a stage writes on its way are deleted when its result is written.

1. quality rules: documents that fail the base rules or the log-likelihood threshold go;
2. n-gram Jaccard join: of each class of near copies the document with the least id stays;
3. mixing: every document as often as the mix to target weights takes it (never, up to three times);
4. SentencePiece: the piece ids of every document, decoded again and compared with the text (decodes_back).

Defined cases: a document with a null or empty text fails the base rules of stage 1 and goes; a null doc_id is in no class
and stays in stage 2; of repeated rows one stays in stage 2; a null source is a source of its own; very long texts are
handled whole; extra columns travel through the first three stages, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, lattice, mixing, quality
from lodestone.llm.common import saved_alone


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_rows=True)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode(docs, lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model")), read_back=True)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: SQL cannot express the shingle classes and the piece ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = saved_alone(spark, f"pipeline-{name.replace(' ', '-')}", lambda: stage(spark, before, sf_dir))  # noqa: B023
    return docs
