"""Document fingerprints: one-permutation MinHash with optimal densification.

Shingles (five words by default) are hashed once.  The top bits of a hash name one of
``bins`` bins, the rest is its value, and each bin keeps its smallest value.  An empty bin borrows from
a bin that a universal hash of (bin, attempt) names, attempt after attempt, until a filled one is met; the
borrowing order is the same for all texts, so likeness survives.  Of each value the lowest ``bits`` bits
are stored.  Two fingerprints agree by chance in 1 / 2**bits of the bins that differ; the likeness is corrected for
that and clipped to 0..1.

Defined results: null counts as empty; a text without words has the empty fingerprint, which is
like (1.0) another empty one and unlike (0.0) any other; a text of fewer than five words has one shingle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparsile.llm.text import Hashes, cut_by_bytes, mixed, raw, shingle_hashes

BINS = 256
BITS = 8


def _borrow(bins: np.ndarray, attempt: int, n_bins: int) -> np.ndarray:
    return (mixed(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(n_bins)).astype(np.int64)


def pack(hashes: np.ndarray, per: np.ndarray, n_bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints of texts, given the shingle hashes of each."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(len(per) * n_bins, empty)
    owner = np.repeat(np.arange(len(per)), per)
    shift = np.uint64(64 - (n_bins - 1).bit_length())
    np.minimum.at(table, owner * n_bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    table = table.reshape(len(per), n_bins)
    filled = table != empty
    rows, bins = np.nonzero(~filled & (per > 0)[:, None])
    attempt = 0
    while len(rows):
        source = _borrow(bins, attempt, n_bins)
        found = filled[rows, source]
        table[rows[found], bins[found]] = table[rows[found], source[found]]
        rows, bins, attempt = rows[~found], bins[~found], attempt + 1
    # values are ordered inside a bin by size: scramble them before the low bits are taken
    low = (mixed(table) & np.uint64((1 << bits) - 1)).astype(np.uint16)
    spread = ((low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8).reshape(len(per), -1)
    packed = np.packbits(spread, axis=1)
    return [packed[i].tobytes() if per[i] else b"" for i in range(len(per))]


def likeness_of(left: list[bytes], right: list[bytes], n_bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprint pairs, corrected for chance agreement."""
    width = n_bins * bits // 8
    blank = bytes(width)
    a, b = (np.frombuffer(b"".join(x or blank for x in side), np.uint8).reshape(len(side), width) for side in (left, right))
    if bits == 8:
        agree = (a == b).sum(1)
    else:
        agree = ~(np.unpackbits(a ^ b, axis=1)[:, : n_bins * bits].reshape(len(left), n_bins, bits).any(2))
        agree = agree.sum(1)
    chance = 2.0**-bits
    out = np.clip((agree / n_bins - chance) / (1 - chance), 0.0, 1.0)
    none = np.array([(not x) + (not y) for x, y in zip(left, right)])
    return np.where(none == 0, out, np.where(none == 2, 1.0, 0.0))


def fingerprints(texts: list[bytes], memo: Hashes, n_bins: int = BINS, bits: int = BITS) -> list[bytes]:
    hashes, per = shingle_hashes(texts, memo)
    return pack(hashes, per, n_bins, bits)


def fingerprint(text: Column, n_bins: int = BINS, bits: int = BITS) -> Column:
    """Hex fingerprint of each text."""

    @arrow_udf("string")
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Hashes()
        for part in parts:
            yield pa.array([x.hex() for piece in cut_by_bytes(part) for x in fingerprints(raw(piece), memo, n_bins, bits)], type=pa.string())

    return packed(text)


def likeness(left: Column, right: Column, n_bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated similarity of two hex fingerprints; null is the empty fingerprint."""

    @arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = [[bytes.fromhex(x or "") for x in side.to_pylist()] for side in (a, b)]
        return pa.array(likeness_of(*sides, n_bins, bits))

    return alike(left, right)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None, n_bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Documents are ordered by ``key`` (nulls first, ties by a hash of the text); after the last comes the
    first.  Texts move once, into ranges of keys cut at approximate quantiles; the first
    document of each range is also sent to the range before it.  The driver sees one key per range.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.xxhash64(text).alias("hash"))
    cuts = sorted(set(docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)))

    def range_of(value: int | None) -> int:
        return 0 if value is None else 1 + bisect_left(cuts, value)

    @arrow_udf("int")
    def ranges(keys: pa.Array) -> pa.Array:
        return pa.array([range_of(x) for x in keys.to_pylist()], type=pa.int32())

    first_rows = rows.select("key", "hash", ranges("key").alias("part")).groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull(), "key", "hash")).alias("f"), F.max(F.col("key").isNull()).alias("nulls")).orderBy("part").collect()
    before = {(r.f["key"], r.f["hash"]): first_rows[i - 1].part for i, r in enumerate(first_rows)}

    @arrow_udf("array<struct<part:int, ahead:boolean>>")
    def places(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("part", pa.int32()), ("ahead", pa.bool_())]))
        out = []
        for k, h in zip(keys.to_pylist(), hashes.to_pylist()):
            own = [{"part": range_of(k), "ahead": False}]
            ahead = before.get((k, h))
            out.append(own if ahead is None else [*own, {"part": ahead, "ahead": True}])
        return pa.array(out, type=kind)

    placed = rows.withColumn("place", F.explode(places("key", "hash"))).select("key", "body", "hash", "place.*")
    sorted_rows = placed.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.col("key").asc_nulls_first(), "hash")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        held: list[tuple] = []
        for batch in batches:
            at = 0
            for piece in cut_by_bytes(batch.column("body")):
                part = batch.slice(at, len(piece))
                at += len(piece)
                held += zip(part.column("part").to_pylist(), part.column("ahead").to_pylist(), part.column("key").to_pylist(), raw(piece))
                pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i + 1][0] == held[i][0]]
                if pairs:
                    texts = [h[3] for h in held]
                    decoded = [t.decode() for t in texts]
                    edits = [edited_text(decoded[i], decoded[i + 1]).encode() for i in pairs]
                    prints = fingerprints(texts + edits, memo, n_bins, bits)
                    own, edit, following = [prints[i] for i in pairs], prints[len(texts):], [prints[i + 1] for i in pairs]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([held[i][2] for i in pairs], type=batch.schema.field("key").type), pa.array([len(decoded[i]) for i in pairs], type=pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array([x.hex() for x in own]), pa.array([x.hex() for x in edit]),
                        pa.array(likeness_of(own, edit, n_bins, bits)), pa.array(likeness_of(own, following, n_bins, bits)),
                    ], names=["key", *[x.split()[0] for x in EDITED.split(", ")]])
                held = held[-1:]

    key_type = docs.schema[key].dataType.simpleString()
    return sorted_rows.select("key", "body", "part", "ahead").mapInArrow(walk, f"key {key_type}, {EDITED}").withColumnRenamed("key", key)
