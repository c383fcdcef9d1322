"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, rows: int) -> pa.RecordBatch:
    """(text, label) of the ``rows`` labels with the smallest hash of their key, in that order.  The labels are
    picked before they meet the texts, so what is broadcast and what reaches the driver is bounded by ``rows``.
    A label whose key has several texts takes the one with the smallest hash.
    Labels without a value or a document, and null texts, are left out."""
    picked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("hash")).orderBy("hash", "key", "label").limit(rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    joined = texts.join(F.broadcast(picked.withColumn("place", F.row_number().over(W.orderBy("hash", "key", "label")))), "key")
    one = joined.groupBy("place").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.first(c).alias(c) for c in ("label", "hash", "key")])
    found = one.select("text", "label", "hash", "key").toArrow()
    found = found.sort_by([("hash", "ascending"), ("key", "ascending"), ("label", "ascending")]).select(["text", "label"]).combine_chunks()
    return found.to_batches()[0] if found.num_rows else pa.RecordBatch.from_pydict({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
