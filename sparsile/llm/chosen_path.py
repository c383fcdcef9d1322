"""N-gram Jaccard join by chosen paths.

Documents become sets of word shingles (five words by default).  A run splits all sets on tokens sampled from
each: the tokens that the run's coordinates choose (the least under a random order), so two sets take the same branch as
often as they are alike.  A bucket of up to ``LEAF`` sets is compared at once; a larger one is split again on freshly chosen
tokens, two branches at every step, which keeps the chance of a linked pair to stay together from shrinking with depth.  Splitting
stops where it no longer helps (a child as large as half its parent: its sets are alike) and at ``DEPTH``; such buckets
are compared in tiles.  Runs repeat until the chance to miss a pair at the threshold is below 1 - ``recall``.

Equal sets are one set with a number of copies, so copies never meet in pairs.  A pair that shares several buckets belongs
to the first of them, which both sides know from their lists of buckets; links can so be counted without emitting
pairs.  Inside a bucket the coordinates' agreement rules pairs out (a pair at the threshold fails with a chance of about
one in a million); the rest are verified on their whole shingle sets.

Defined results: null counts as empty; all texts without words form one class (of copies); a text of fewer than five words
has one shingle; the class id is the least key of the class (nulls last, then the least hash of the text); links of a document count every other document
whose set has at least the threshold's similarity, copies included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.llm.components import connected
from sparsile.llm.text import Hashes, cut_by_bytes, mixed, per_text, raw, shingle_hashes
from sparsile.session import durable

THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 48
LEAF = 512
DEPTH = 4
BRANCHES = 2
_ORDERS = (mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))


def runs_for(threshold: float, recall: float) -> int:
    """Runs so that a pair at the threshold is missed with a chance below 1 - recall.  With two branches, the chance s
    to stay together in one run is at the fixed point s = 1 - (1 - threshold * s)**2 or above."""
    s = 1.0
    for _ in range(DEPTH):
        s = 1 - (1 - threshold * s) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def least_agreement(threshold: float, miss: float = 1e-6) -> int:
    """The number of coordinates of which a pair at the threshold shares fewer only with the chance ``miss``."""
    total = 0.0
    for k in range(COORDINATES + 1):
        total += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        if total > miss:
            return k
    return COORDINATES


def _sets(texts: list[bytes], memo: Hashes) -> list[np.ndarray]:
    hashes, per = shingle_hashes(texts, memo)
    ends = np.cumsum(per)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), per.tolist())]


def _set_keys(sets: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """128-bit names of sets: two sums of scrambled members."""
    members = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    sums = [per_text(mixed(members ^ np.uint64(salt)).view(np.int64), sizes) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [a + b for a, b in zip(*[[x.tobytes() for x in s.astype("<i8")] for s in sums])]


def _coordinates(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The least member of each set under each random order, as 32-bit numbers."""
    out = np.zeros((len(sets), COORDINATES), np.int32)
    some = np.flatnonzero(sizes)
    if len(some):
        members = np.concatenate([sets[i] for i in some])
        firsts = np.cumsum(sizes[some]) - sizes[some]
        for c in range(COORDINATES):
            out[some, c] = (np.minimum.reduceat(members * _ORDERS[c], firsts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Hashes()
    for batch in batches:
        at = 0
        for piece in cut_by_bytes(batch.column("body")):
            part = batch.slice(at, len(piece))
            at += len(piece)
            sets = _sets(raw(piece), memo)
            sizes = np.array([len(s) for s in sets], np.int64)
            coordinates = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(_coordinates(sets, sizes).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("hash"), pa.array(_set_keys(sets, sizes), pa.binary()), pa.array(sizes), coordinates], names=["key", "hash", "id", "n", "at"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Hashes()
    for batch in batches:
        for piece in cut_by_bytes(batch.column("body")):
            sets = _sets(raw(piece), memo)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(sets, sizes), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows in order of bucket and tile, as tables with the bounds of their whole tiles."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> list[int]:
        keys = [table.column(n).to_numpy() for n in ("path", "tile", "other")]
        changed = np.zeros(max(len(table) - 1, 0), bool)
        for k in keys:
            changed |= k[1:] != k[:-1]
        return [0, *(np.flatnonzero(changed) + 1).tolist(), len(table)]

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), list(zip(bounds[:-2], bounds[1:-1]))
            held = table.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if len(table):
            yield table, [(0, len(table))]


def _owned(path: int, paths: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs whose first common bucket is ``path``."""
    earlier = [p[p < path] for p in paths]
    flat, sizes = np.concatenate(earlier), [len(e) for e in earlier]
    if not len(flat):
        return np.ones(len(left), bool)
    if len(left) <= 4 * len(paths):
        return np.fromiter((not np.isin(earlier[i], earlier[j]).any() for i, j in zip(left, right)), bool, len(left))
    codes, uniques = pd.factorize(flat)
    held = np.zeros((len(paths), len(uniques)), np.float32)
    held[np.repeat(np.arange(len(paths)), sizes), codes] = 1
    return (held @ held.T)[left, right] == 0


def _candidates(rows: dict[str, np.ndarray], paths: list[np.ndarray], threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile that may be linked and belong to its bucket."""
    m = len(rows["n"])
    left, right = np.triu_indices(m, 1)
    if rows["tile"][0] != rows["other"][0]:
        across = rows["group"][left] != rows["group"][right]
        left, right = left[across], right[across]
    n = rows["n"]
    near = np.minimum(n[left], n[right]) >= threshold * np.maximum(n[left], n[right]) - 1e-9
    left, right = left[near], right[near]
    alike = np.zeros(len(left), np.uint8)
    at = rows["at"]
    for c in range(COORDINATES):
        alike += at[left, c] == at[right, c]
    left, right = left[alike >= least], right[alike >= least]
    if not len(left):
        return left, right
    own = _owned(int(rows["path"][0]), paths, left, right)
    return left[own], right[own]


def _common(members: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(left) <= 4 * len(members):
        return np.fromiter((len(np.intersect1d(members[i], members[j], assume_unique=True)) for i, j in zip(left, right)), np.int64, len(left))
    sizes = np.array([len(x) for x in members])
    codes, uniques = pd.factorize(np.concatenate(members))
    often = np.bincount(codes, minlength=len(uniques)) > 1
    number = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(members)), sizes)
    kept = often[codes]
    owner, column = owner[kept], number[codes[kept]]
    out = np.zeros(len(left), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        table = np.zeros((len(members), 4096), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        out += (table @ table.T)[left, right]
    return np.rint(out).astype(np.int64)


def _columns(table: pa.Table) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    names = ("path", "tile", "other", "group", "n", "copies")
    rows = {n: table.column(n).to_numpy() for n in names}
    rows["at"] = table.column("at").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), COORDINATES)
    lists = table.column("paths").combine_chunks()
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = (offsets - offsets[0]).tolist()
    return rows, [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _promising(threshold: float, least: int):
    """Keeps the rows of a tile that have a candidate partner there."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _chunks(batches):
            rows, paths = _columns(table)
            found = np.zeros(len(table), bool)
            for a, b in bounds:
                if b - a > 1:
                    left, right = _candidates({k: v[a:b] for k, v in rows.items()}, paths[a:b], threshold, least)
                    found[a + left] = True
                    found[a + right] = True
            yield from table.filter(pa.array(found)).to_batches()

    return keep


def _verified(threshold: float, least: int):
    """Counts links and names the least set of each connected group of a tile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _chunks(batches):
            rows, paths = _columns(table)
            ids, blobs = table.column("id").to_pylist(), table.column("members").to_pylist()
            for a, b in bounds:
                first = {ids[i]: i for i in range(b - 1, a - 1, -1)}  # rows that came twice count once
                at = np.array(sorted(first.values(), key=ids.__getitem__))
                if len(at) < 2:
                    continue
                own = {k: v[at] for k, v in rows.items()}
                left, right = _candidates(own, [paths[i] for i in at], threshold, least)
                if not len(left):
                    continue
                common = _common([np.frombuffer(blobs[i], np.uint64) for i in at], left, right)
                linked = common >= threshold * (own["n"][left] + own["n"][right] - common) - 1e-9
                left, right = left[linked], right[linked]
                links = np.bincount(left, own["copies"][right], len(at)) + np.bincount(right, own["copies"][left], len(at))
                root = np.arange(len(at))
                while len(left):
                    low = np.minimum(root[left], root[right])
                    new = root.copy()
                    np.minimum.at(new, left, low)
                    np.minimum.at(new, right, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([ids[at[i]] for i in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([ids[at[root[i]]] for i in some], pa.binary())], names=["id", "links", "root"])

    return count


def _leaves(sets: DataFrame, runs: int) -> DataFrame:
    """(id, path, size): the buckets in which sets are compared."""
    first = BRANCHES * runs
    spare = COORDINATES - first
    rows = sets.filter("n > 0").select("id", F.posexplode(F.slice("at", 1, first))).select("id", F.xxhash64(F.lit(0), "pos", "col").alias("path"), F.lit(None).cast("long").alias("parent_size"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = durable(rows, "paths") if depth > 1 else rows
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        live = durable(rows.join(sizes, "path"), "buckets")
        stop = (F.col("size") <= LEAF) | F.lit(depth == DEPTH) | F.coalesce(F.col("size") * 2 > F.col("parent_size"), F.lit(False))
        done = live.filter(stop).select("id", "path", "size")
        leaves = done if leaves is None else leaves.union(done)
        more = live.filter(~stop)
        if depth == DEPTH or more.isEmpty():
            break
        # two different spare coordinates, chosen by the path
        start = F.pmod(F.xxhash64("path"), F.lit(spare))
        step = 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(spare - 1))
        picks = F.array(*[F.pmod(start + F.lit(b) * step, F.lit(spare)).cast("int") for b in range(BRANCHES)])
        rows = more.withColumn("pick", F.explode(picks)).join(sets.select("id", "at"), "id").select(
            "id", F.xxhash64("path", "pick", F.element_at("at", F.col("pick") + first + 1)).alias("path"), F.col("size").alias("parent_size"))
    return leaves


def _classes(docs: DataFrame, threshold: float, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, hash, id) of every row, and (id, class_id, n_links, keep) of every distinct set; ``keep`` is the
    (key, hash) that stands for the class."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type = docs.schema[key].dataType.simpleString()
    least = least_agreement(threshold)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.xxhash64(text).alias("hash"))
    summaries = durable(rows.mapInArrow(_summaries, f"key {key_type}, hash long, id binary, n long, at array<int>"), "summaries")
    # among equal sets the least key stands for all; nulls come last
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("best")
    sets = durable(summaries.groupBy("id").agg(best, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("at").alias("at")).select(
        "id", F.col("best.key").alias("key"), F.col("best.hash").alias("hash"), "copies", "n", "at"), "sets")

    leaves = durable(_leaves(sets, runs_for(threshold, recall)), "leaves")
    lists = leaves.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    tiles = F.ceil(F.col("size") / LEAF).cast("int")
    placed = leaves.withColumn("tiles", tiles).withColumn("group", F.pmod(F.xxhash64("id", "path"), F.col("tiles")).cast("int")).withColumn(
        "pair", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "id", "path", "group", F.least("group", "pair").alias("tile"), F.greatest("group", "pair").alias("other"))
    live = sets.join(lists, "id").select("id", "n", "copies", "at", "paths")
    unit = ["path", "tile", "other"]
    full = placed.join(live, "id").repartition(parts, *unit).sortWithinPartitions(*unit)
    promising = durable(full.mapInArrow(_promising(threshold, least), full.schema), "promising")

    wanted = promising.select("id").distinct().join(sets.select("id", "key", "hash"), "id").select(F.col("key").alias("k"), F.col("hash").alias("h"))
    members = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & F.col("hash").eqNullSafe(F.col("h")), "left_semi").select("body").mapInArrow(_members, "id binary, members binary")
    checked = promising.join(members, "id").repartition(parts, *unit).sortWithinPartitions(*unit)
    found = durable(checked.mapInArrow(_verified(threshold, least), "id binary, links long, root binary"), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = sets.select("id", "key", "hash", "copies").join(links, "id", "left").join(roots.withColumnRenamed("u", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("keep"))
    by_set = named.join(classes, "root").select("id", F.col("keep.key").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "keep")
    return summaries.select("key", "hash", "id"), by_set


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links) of every document."""
    rows, by_set = _classes(docs, threshold, recall, key, text)
    return rows.join(by_set, "id").select(F.col("key").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their classes, one of each, with all their columns."""
    rows, by_set = _classes(docs, threshold, recall, key, text)
    kept = by_set.select("keep.key", "keep.hash").distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))  # other columns may have any names
    found = packed.join(kept, F.col("k").eqNullSafe(F.col("key")) & F.col("h").eqNullSafe(F.col("hash")), "left_semi")
    if not rows.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():  # rows equal in key and text
        found = found.dropDuplicates(["k", "h"])
    return found.select("row.*")
