"""Sharding by rendezvous hashing over weighted shards.

A record goes to the shard with the highest score ``weight / -ln(u)``, where ``u`` in (0, 1) is a hash of the
record's key and the shard.  A shard wins in proportion to its weight, and a new shard takes records only into
itself: all other scores stay as they were.  Everything is built-in expressions, so rows
are placed where they are read.

Defined results: null keys hash like one key of their own, so they share a shard; records of one key share a
shard whatever their texts; equal scores go to the lower shard; a null text has 0 bytes and crc32 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.session import durable

ROWS_PER_BUCKET = 10_000


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(float(weight)) / -F.log(unit)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, …) of a key; a weight of 0 or less takes nothing."""
    scores = [F.struct(shard_score(key, s, w).alias("s"), F.lit(-s).alias("n")) for s, w in enumerate(weights) if w > 0]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["n"]).cast("int")


def assign_slots(rows: DataFrame, shard: str, slot: str, order: list[str], total: int) -> DataFrame:
    """Gapless numbers from 0 inside each shard.

    Rows of a shard are first dealt over hash buckets; counts per bucket give each bucket its
    first number, so no window holds more than one bucket of one shard.
    """
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = W.partitionBy(shard, "_bucket").orderBy(*order)
    return dealt.join(starts, [shard, "_bucket"]).withColumn(slot, F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start")


def place(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every record; ``grown_shard`` is its shard
    once one more shard of weight 1 (or the mean weight) is added."""
    own = weights or [1.0] * shards
    more = [*own, sum(own) / len(own)]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = durable(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), own).alias("shard"), shard_of(F.col(key), more).alias("grown_shard")), "shards")
    placed = assign_slots(rows, "shard", "slot", ["key", "text_crc32", "size"], rows.count())
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
