"""A training corpus from raw documents: quality classifier, near duplicates, secrets, mix, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns documents
(the last one: what the encoder made of them).  ``run`` writes each stage's rows to the shared folder
and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsile.llm import chosen_path, gam, pareto_mix, piece_codec, trigram_scan
from sparsile.session import durable

KEPT_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.7 or more.  It learns from labels outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = gam.train(docs, labels)
    return docs.filter(gam.score(F.col("text"), model) >= KEPT_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near copies."""
    return chosen_path.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    masked = docs.withColumn("text", trigram_scan.mask_secrets(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return pareto_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of each copy in the mix."""
    encoded = piece_codec.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "source", encoded.alias("r")).select("doc_id", "source", "r.*")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scan", secrets), ("mixing", mixture), ("piece encoding", encoding)]
# Trained models, near-duplicate search and tokenizers are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
