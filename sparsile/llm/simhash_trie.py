"""SimHash near duplicates by a self-join of the binary trie of fingerprints.

A fingerprint has 64 bits: bit b is 1 if more than half of a text's shingles (three words by default, repeats included) have bit
b set in their 64-bit hash.  Two fingerprints link if they differ in at most ``errors`` bits.  Documents with one
fingerprint are one row from the start, so groups of copies never meet in pairs.

The join walks the trie from its root with pairs of nodes: a pair goes on to the pairs of its children, with one differing bit more
where the children's bits differ, and is dropped once the bits that differ exceed the error budget.  Nodes are ranges of a
sorted array, so all pairs of a level take one numpy step; a pair of small nodes is finished by comparing its fingerprints.
Pairs of nodes whose fingerprints already hang together are dropped too, which keeps a dense cluster from being compared
pair by pair: only classes are wanted, and every link between different classes is still found.

Spread over tasks, the trie is cut into cells (nodes).  A fingerprint goes to its own cell and to one of each two cells that
its own cell may link to, so every pair of cells meets in one task.  A task holds the fingerprints of one cell and
streams those of the other cells past them.  Cells are chosen from a sample of at most ``SAMPLE`` fingerprints, which
only balances them; crowded parts of the trie are cut deeper.  Classes of the links are found by star contraction.

Defined results: null counts as empty; a text of fewer words than a shingle has one shingle, of all its words; a text
without words has fingerprint zero and links like any other; very long texts are hashed in parts of ``PART_BYTES``; the
component id is the least key of the component, null only where all its keys are null; repeated rows are kept, each with its
component; an empty table gives no rows; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparsile.llm.components import connected
from sparsile.llm.text import BLANKS, raw
from sparsile.session import durable

BITS = 64
WIDTH = 3
ERRORS = 3
SEED = 42
PART_BYTES = 1 << 20
SAMPLE = 1 << 16
LEAST_CELLS, MOST_CELLS = 256, 4096
CELL_ROWS = 1 << 16
FRONTIER = 1 << 18  # node pairs of one numpy step
FINISH = 8  # pairs of fingerprints below which two nodes are compared at once
HEAVY = 1000  # a fingerprint of more than 1 / HEAVY of all rows is looked up in place
_ONE = np.uint64(1)


# ---- fingerprints ----------------------------------------------------------

def word_parts(text: bytes, size: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes."""
    start = 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):  # up to the next blank
            found = [i for i in (text.find(b, stop) for b in (bytes([x]) for x in BLANKS)) if i >= 0]
            stop = min(found, default=len(text))
        yield text[start:stop].split()
        start = stop


def fingerprint_of(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of one text; capitals A to Z are lower-cased."""
    ones, total, before = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_parts(text.lower()):
        words = before + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
            hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=">u8", count=len(words) - width + 1)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        before = words[-(width - 1):] if width > 1 else []
    if not total and before:
        return digest(b" ".join(before), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint of each text as a long (its 64 bits as they are)."""

    @arrow_udf("long")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([fingerprint_of(t, width) for t in raw(part)], dtype=np.uint64).view(np.int64))

    return found(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ---- classes inside a task -------------------------------------------------

class Classes:
    """Classes of the numbers 0, 1, …; the least number stands for its class."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            a, b = self.root[left], self.root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class Side:
    """One sorted array of distinct fingerprints in the join, and the classes of its rows."""

    def __init__(self, values: np.ndarray, classes: Classes, first: int) -> None:
        self.values, self.classes, self.first = values, classes, first
        self._bit, self._ones = -1, None
        self.refresh()

    def refresh(self) -> None:
        self.label = self.classes.root[self.first : self.first + len(self.values)]
        self.changes = np.zeros(len(self.values), np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=self.changes[1:])

    def middle(self, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        """Where the ones of a bit start, in ranges that agree in all bits before it."""
        if self._bit != bit:
            self._ones = np.zeros(len(self.values) + 1, np.int64)
            np.cumsum((self.values >> np.uint64(BITS - 1 - bit)) & _ONE, out=self._ones[1:], dtype=np.int64)
            self._bit = bit
        return high - (self._ones[high] - self._ones[low])

    def uniform(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.changes[low] == self.changes[high - 1]


def join_tries(a: Side, b: Side, same: bool, errors: int) -> None:
    """Unite the classes of all fingerprints of ``a`` and ``b`` (``same``: one array, each pair once) within ``errors`` bits."""
    if not len(a.values) or not len(b.values):
        return
    whole = lambda n: np.array([n])
    stack = [(0, whole(0), whole(len(a.values)), whole(0), whole(len(b.values)), whole(0))]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONTIER:
            cuts = range(0, len(a0), FRONTIER)
            stack += [(bit, *[x[i : i + FRONTIER] for x in (a0, a1, b0, b1, spent)]) for i in cuts]
            continue
        # what hangs together already needs no comparing
        apart = ~(a.uniform(a0, a1) & b.uniform(b0, b1) & (a.label[a0] == b.label[b0]))
        a0, a1, b0, b1, spent = (x[apart] for x in (a0, a1, b0, b1, spent))
        small = (a1 - a0) * (b1 - b0) <= FINISH
        if bit == BITS:
            small[:] = True
        if small.any():
            _finish(a, b, a0[small], a1[small], b0[small], b1[small], errors)
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        am, bm = a.middle(a0, a1, bit), b.middle(b0, b1, bit)
        own = same & (a0 == b0) & (a1 == b1)  # a node with itself: its children meet once
        parts = [(a0, am, b0, bm, spent, None), (am, a1, bm, b1, spent, None), (a0, am, bm, b1, spent + 1, None), (am, a1, b0, bm, spent + 1, ~own)]
        kept = []
        for w0, w1, x0, x1, cost, also in parts:
            live = (w0 < w1) & (x0 < x1) & (cost <= errors)
            if also is not None:
                live &= also
            kept.append([y[live] for y in (w0, w1, x0, x1, cost)])
        stack.append((bit + 1, *[np.concatenate(c) for c in zip(*kept)]))


def _finish(a: Side, b: Side, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, errors: int) -> None:
    """Compare all fingerprints of small pairs of nodes."""
    sizes = (a1 - a0) * (b1 - b0)
    pair = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = a0[pair] + place // (b1 - b0)[pair], b0[pair] + place % (b1 - b0)[pair]
    near = np.bitwise_count(a.values[left] ^ b.values[right]) <= errors
    if near.any():
        a.classes.link(a.first + left[near], b.first + right[near])
        a.refresh()
        b.refresh()


def _cell_links(errors: int):
    """Arrow batches of (cell, mine, fp), a cell's own fingerprints first, to links (u, v) that join the classes."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
        for batch in batches:
            cell, other, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "other", "fp"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(other) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cell)]):
                if high > low:
                    yield int(cell[low]), bool(other[low]), fp[low:high].view(np.uint64)

    def links_of(mine: np.ndarray, classes: Classes) -> pa.RecordBatch:
        moved = np.flatnonzero(classes.root != np.arange(len(mine)))
        return as_batch(mine[moved], mine[classes.root[moved]])

    def as_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, mine, classes = None, [], None, None

        def close() -> None:
            nonlocal mine, classes, gathered
            mine = np.unique(np.concatenate(gathered)) if gathered else np.empty(0, np.uint64)
            gathered, classes = [], Classes(len(mine))
            side = Side(mine, classes, 0)
            near = np.flatnonzero(np.bitwise_count(mine[1:] ^ mine[:-1]) <= errors)
            classes.link(near, near + 1)  # neighbours first: most of a cluster hangs together from the start
            side.refresh()
            join_tries(side, side, True, errors)

        for cell, other, fp in runs(batches):
            if cell != current:
                if current is not None:
                    if mine is None:
                        close()
                    yield links_of(mine, classes)
                current, gathered, mine = cell, [], None
            if not other:
                gathered.append(fp.copy())
                continue
            if mine is None:
                close()
            if not len(mine):
                continue
            # the streamed fingerprints come after the cell's own, so an own one stands for every class they join
            theirs = np.unique(fp)
            both = Classes(len(mine) + len(theirs))
            both.root[: len(mine)] = classes.root
            join_tries(Side(mine, both, 0), Side(theirs, both, len(mine)), False, errors)
            found = both.root[len(mine):]
            hit = np.flatnonzero(found < len(mine))
            yield as_batch(theirs[hit], mine[found[hit]])
            classes.root = both.root[: len(mine)].copy()
        if current is not None:
            if mine is None:
                close()
            yield links_of(mine, classes)

    return join


# ---- cells -----------------------------------------------------------------

def cut_cells(sample: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(first value, depth) of trie nodes that tile all values, deeper where the sample is dense."""
    values = np.sort(sample)
    wanted = max(1, len(values) // n_cells)
    starts, depths = [], []
    stack = [(0, 0, 0, len(values))]
    while stack:
        start, depth, low, high = stack.pop()
        if depth == BITS or high - low <= wanted or values[low] == values[high - 1]:
            starts.append(start)
            depths.append(depth)
            continue
        half = start | 1 << (BITS - 1 - depth)
        middle = low + int(np.searchsorted(values[low:high], np.uint64(half)))
        stack += [(half, depth + 1, middle, high), (start, depth + 1, low, middle)]
    return np.array(starts, dtype=np.uint64), np.array(depths, dtype=np.int64)


def prefix_distance(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Differing bits among the first ``depth``."""
    shift = np.uint64(BITS) - depth.astype(np.uint64)
    return np.bitwise_count(np.where(depth > 0, (a ^ b) >> np.minimum(shift, np.uint64(BITS - 1)), np.uint64(0)))


def _dealt(starts: np.ndarray, depths: np.ndarray, errors: int):
    """Fingerprints to rows (cell, other, fp): their own cell, and the linked cells in which their pairs meet."""
    n = len(starts)
    x, y = np.divmod(np.arange(n * n), n)
    linked = prefix_distance(starts[x], starts[y], np.minimum(depths[x], depths[y])) <= errors
    # of two cells one is chosen to hold their pairs, about as often either
    holds = np.where((x + y) % 2 == 0, x < y, x > y)
    use = linked & holds
    owner, guest = x[use], y[use]
    order = np.argsort(guest, kind="stable")
    owner, first = owner[order], np.searchsorted(guest[order], np.arange(n + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                cell = np.searchsorted(starts, fp, side="right") - 1
                per = first[cell + 1] - first[cell]
                row = np.repeat(np.arange(len(fp)), per)
                to = owner[np.repeat(first[cell], per) + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)]
                near = prefix_distance(fp[row], starts[to], depths[to]) <= errors
                row, to = row[near], to[near]
                columns = [np.concatenate([cell, to]).astype(np.int32), np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(row), np.int8)]), np.concatenate([fp, fp[row]]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "other", "fp"])

    return deal


def links(prints: DataFrame, errors: int = ERRORS, n_cells: int | None = None) -> DataFrame:
    """(u, v): links that join all fingerprints of ``prints`` (fp, distinct) which hang together within ``errors`` bits."""
    spark = prints.sparkSession
    n = prints.count()
    n_cells = n_cells or min(max(LEAST_CELLS, n // CELL_ROWS), MOST_CELLS)
    # the rows of least hash: a bounded sample that only places the cuts between cells
    share = min(1.0, SAMPLE / max(n, 1)) * 0.98
    picked = prints if n <= SAMPLE else prints.filter(F.xxhash64(F.lit(1), "fp").cast("double") < (share - 0.5) * 2.0**64)
    sample = picked.select("fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    starts, depths = cut_cells(sample, n_cells)
    parts = min(len(starts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = prints.select("fp").mapInArrow(_dealt(starts, depths, errors), "cell int, other byte, fp long")
    placed = dealt.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", "other")
    return placed.mapInArrow(_cell_links(errors), "u long, v long")


def classes(docs: DataFrame, errors: int = ERRORS, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    rows = durable(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), width).alias("fp")), "fingerprints")
    prints = durable(rows.groupBy("fp").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")), "prints")
    found = durable(links(prints, errors), "links")
    roots = connected(found)
    named = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("key").alias("component_id"))
    table = durable(named.join(least, "root").select("fp", "n", "component_id"), "components")
    # fingerprints of many rows are few: at most HEAVY of them hold more than 1 / HEAVY of all rows each
    limit = F.lit(rows.count() / HEAVY)
    hot = table.filter(F.col("n") > limit).select("fp", F.struct("component_id").alias("hot"))
    seen = rows.join(F.broadcast(hot), "fp", "left")
    cold = seen.filter("hot IS NULL").select("key", "fp").join(table.filter(F.col("n") <= limit).select("fp", "component_id"), "fp")
    out = seen.filter("hot IS NOT NULL").select("key", "fp", "hot.component_id").union(cold.select("key", "fp", "component_id"))
    return out.select(F.col("key").alias(key), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
