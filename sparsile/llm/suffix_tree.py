"""Language-model scores from a probabilistic suffix tree.

A text is read as its words (ASCII capitals lower-cased), each closed by a blank, then one end mark; symbols are the
UTF-8 bytes, the blank and the end mark, so the tree gives every possible text a probability.  A context is a run of
up to ``DEPTH`` symbols before the next one.  It becomes a state if it occurs at least ``LEAST`` times in training
and its next-symbol distribution diverges from its parent's (the context without its oldest symbol): count times
Kullback-Leibler divergence above ``DIVERGENCE`` nats.  A state's distribution is its counts, smoothed towards its
parent's with a weight of ``BACKING`` per distinct symbol.  A symbol is scored in the longest suffix
of what stands before it that is a state, in a row from the root.

Counts cover every training document, and the tree grows with the corpus.  It is never whole in one place.  Documents
stand in blocks of about ``BLOCK_BYTES`` of text, a row for each piece of ``PIECE_BYTES``; a block sends its distinct
grams and words, packed in arrays, to parts by the nearest three symbols of the context or a hash of the word.  Where all
blocks meet in a part, counts are added up, that part of the tree is grown, and each block gets its own grams and words
back with their values.  So neither a gram nor a word is ever a row, and texts move once.  Only the counts of single
symbols, pairs and triples reach the driver: their number depends on the script of the texts, not on the size of the
corpus.

The base score has the same terms but for the number of distinct words, known once all parts have answered.

Defined results: null counts as empty; an empty text is its end mark; rows equal in key and text get equal scores, one each;
without training documents V = N = 0, no token is known and the base score takes its formula's limit with V + 1 = 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsile.llm.text import cut_by_bytes, raw
from sparsile.session import durable

DEPTH = 6
LEAST = 2
DIVERGENCE = 8.0
BACKING = 1.0
KEPT_GRAMS = 2_000_000
BLOCK_BYTES = 16_000_000
ROW_BYTES = 64  # what a document counts in a block besides its text
PART_SYMBOLS = 4_000_000
MOST_PARTS = 1024  # a block sends as many rows at most, of grams and of words
PIECE_BYTES = 500_000  # a symbol takes some fifty bytes of work arrays
HEAD = 0xFFFFFF  # a symbol and the two before it
SYMBOLS = 257
START, END = 0xFF, 0xFE  # bytes that never occur in UTF-8: before a text, and its end mark
TOTALS = -1  # in place of a block: the distinct training words of a part

# bytes kept for marks give way in texts that are not UTF-8
_LOWER = bytes({START: 0xC1, END: 0xC0}.get(b, b + 32 if 65 <= b <= 90 else b) for b in range(256))
_MARK = bytes([END])


def read_words(texts: list[bytes]) -> list[list[bytes]]:
    return [t.translate(_LOWER).split() for t in texts]


def grams(words: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    return grams_of(joined(words), depth)


def joined(words: list[list[bytes]]) -> bytes:
    """All symbols of the texts: each word with its blank, each text with its mark."""
    return b"".join([b" ".join([*w, _MARK]) for w in words])


def _starts(symbols: np.ndarray) -> np.ndarray:
    """Where each text starts among the symbols of some."""
    return np.concatenate([[0], np.flatnonzero(symbols == END)[:-1] + 1])


def grams_of(symbols: bytes, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of each text the symbol and the ``depth`` before it as one integer, the symbol in the lowest
    byte and the nearest context next; and the number of symbols per text."""
    plain = np.frombuffer(symbols, np.uint8)
    sizes = np.diff(_starts(plain), append=len(plain))
    pad = bytes([START]) * depth
    buffer = np.frombuffer(pad + symbols.replace(_MARK, _MARK + pad)[:-depth], np.uint8)
    codes = buffer[depth:].astype(np.int64)
    for back in range(1, depth + 1):
        codes |= buffer[depth - back : len(buffer) - back].astype(np.int64) << (8 * back)
    # between two texts stands the pad of the later one
    inside = np.ones(len(codes), bool)
    stops = np.cumsum(sizes + depth) - depth
    for offset in range(depth):
        inside[(stops + offset)[:-1]] = False
    return codes[inside], sizes


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def _counted(codes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and how often they occur where ``learn`` holds."""
    both = np.sort(codes << 1 | learn)
    starts = _runs(both >> 1)
    return both[starts] >> 1, np.add.reduceat(both & 1, starts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    starts = _runs(keys)
    return keys[starts], np.add.reduceat(np.concatenate([n for _, n in parts])[order], starts) if len(starts) else np.zeros(0, np.int64)


def _totals(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all parts together; not much more than the distinct keys is held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(k) for k, _ in held) > max(KEPT_GRAMS, 2 * len(held[0][0])):
            held[:] = [_merged(held)]
    return _merged(held)


# Inside a part, grams stand by nearest three symbols, then symbol, then the farther ones: like values are neighbours.
_NEAREST_FIRST, _SYMBOL_LAST = [6, 5, 4, 0, 3, 2, 1, 7], [3, 6, 5, 4, 2, 1, 0, 7]


def _turned(codes: np.ndarray, order: list[int]) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8)[:, order]).view(np.int64).ravel()


def _unpressed(blob: bytes, length: int) -> bytes:
    return pa.decompress(blob, length, codec="zstd", asbytes=True)


def _pressed(body: bytes) -> bytes:
    return pa.compress(body, codec="zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    return _pressed(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(_unpressed(blob, 8 * size), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sorted_keys(blob: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpacked(blob, size))


# Grams have parts from 0, words parts below 0; length: bytes of the words.
_SENT = "part int, block long, size int, length int, keys binary, n binary"
_ANSWER = "block long, part int, size int, length int, keys binary, value binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f for f, _ in fields])


def _sent_grams(block: int, codes: np.ndarray, n: np.ndarray, parts: int) -> list[tuple]:
    """The distinct grams of a block and their counts, a row for each part."""
    keys = _turned(codes, _NEAREST_FIRST)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    part = (((keys >> 32) * 0x9E3779B1 & 0xFFFFFFFF) >> 12) % parts
    order = np.argsort(part, kind="stable")
    keys, n, part = keys[order], n[order], part[order]
    cuts = [*_runs(part).tolist(), len(part)]
    return [(int(part[a]), block, b - a, 0, _packed(np.diff(keys[a:b], prepend=0)), _packed(n[a:b])) for a, b in zip(cuts, cuts[1:])]


def _sent_words(block: int, seen: dict[bytes, int], parts: int) -> list[tuple]:
    words = sorted(seen)
    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % (parts // 4 + 1)
    order = np.argsort(part, kind="stable")
    part, words = part[order], [words[i] for i in order.tolist()]
    n = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    cuts = [*_runs(part).tolist(), len(part)]
    rows = []
    for a, b in zip(cuts, cuts[1:]):
        body = b" ".join(words[a:b])
        rows.append((-1 - int(part[a]), block, b - a, len(body), _pressed(body), _packed(n[a:b])))
    return rows


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What each block sends: its grams and words with their training counts, 0 for those of other documents only."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: Counter[bytes] = Counter()
    others: set[bytes] = set()
    own = TOTALS

    def sent() -> Iterator[pa.RecordBatch]:
        if held:
            yield _batch(_SENT, _sent_grams(own, *_merged(held), parts))
            yield _batch(_SENT, _sent_words(own, dict.fromkeys(others, 0) | dict(seen), parts))
        held.clear(), seen.clear(), others.clear()

    for batch in batches:
        for block, training, size, body in zip(*(batch.column(c).to_pylist() for c in ("block", "training", "size", "body"))):
            if block != own:
                yield from sent()
                own = block
            symbols, learn = _unpressed(body, size), np.array(training, bool)
            codes, sizes = grams_of(symbols)
            held.append(_counted(codes, np.repeat(learn, sizes)))
            if sum(len(k) for k, _ in held) > max(KEPT_GRAMS, 2 * len(held[0][0])):
                held[:] = [_merged(held)]
            texts = symbols.split(_MARK)
            seen.update(b"".join([x for x, counts in zip(texts, training) if counts]).split())
            others.update(b"".join([x for x, counts in zip(texts, training) if not counts]).split())
    yield from sent()


def _in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents with the number of their block, then (head, n, every): how often a symbol follows the two
    before it in training documents, and in all."""
    names = ["block", "key", "training", "size", "body", "head", "n", "every"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block, room, kinds = 0, -1, []
    for batch in batches:
        kinds = [pa.int64(), pa.list_(batch.column("key").type), pa.list_(pa.bool_()), pa.int32(), pa.binary()]
        at = 0
        for piece in cut_by_bytes(batch.column("body"), min(PIECE_BYTES, block_bytes)):
            own = batch.slice(at, len(piece))
            at += len(piece)
            symbols = joined(read_words(raw(piece)))
            room -= len(symbols) + ROW_BYTES * len(piece)
            if room < 0:  # a block is named after its first row
                block, room = own.column("row")[0].as_py(), block_bytes - len(symbols) - ROW_BYTES * len(piece)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), pa.concat_arrays([own.column(c)])) for c in ("key", "training")]
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), *lists, pa.array([len(symbols)], pa.int32()), pa.array([_pressed(symbols)], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names=names)
            codes, sizes = grams_of(symbols, 2)
            both = np.sort(codes << 1 | np.repeat(own.column("training").to_numpy(zero_copy_only=False).astype(bool), sizes))
            starts = _runs(both)
            held.append((both[starts], np.diff(starts, append=len(both))))
            if len(held) > 16:
                held[:] = [_merged(held)]
    if held:
        both, n = _merged(held)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(both), k) for k in kinds), pa.array(both >> 1), pa.array(n * (both & 1)), pa.array(n)], names=names)


@dataclass
class Heads:
    """Counts of a symbol with the two before it in training (sorted keys), and the symbols of all documents."""

    keys: np.ndarray
    n: np.ndarray
    every: int

    def levels(self, triples: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The complete counts of pairs, then triples, above the given triples of context symbols (nearest highest)."""
        near = np.isin(self.keys >> 8 & 0xFF, triples >> 16)
        pairs, at = np.unique(self.keys[near] & 0xFFFF, return_inverse=True)
        both = np.isin((self.keys >> 8 & 0xFF) << 8 | self.keys >> 16, triples >> 8)
        return [(pairs, np.bincount(at, self.n[near], len(pairs))), (self.keys[both], self.n[both])]

    def symbols(self) -> np.ndarray:
        return np.bincount(self.keys & 0xFF, self.n, 256)

    def parts(self, part_symbols: int) -> int:
        return min(MOST_PARTS, self.every // part_symbols + 1)


def heads_of(rows: DataFrame) -> Heads:
    """From rows (head, n, every), to the driver."""
    found = rows.groupBy("head").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).toArrow()
    keys, n = found.column("head").to_numpy(), found.column("n").to_numpy().astype(float)
    order = np.argsort(keys)
    order = order[n[order] > 0]
    return Heads(keys[order].astype(np.int64), n[order], int(sum(found.column("every").to_pylist())))


def in_blocks(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(block, key, training, size, body) of every piece, kept so that blocks stay as they are; and (head, n, every)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.coalesce(training, F.lit(False)).alias("training"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["key"].dataType.simpleString()
    kept = durable(rows.mapInArrow(
        lambda batches: _in_blocks(batches, block_bytes), f"block long, key array<{kind}>, training array<boolean>, size int, body binary, head long, n long, every long"), "blocks")
    return kept.filter("head IS NULL").select("block", "key", "training", "size", "body"), kept.filter("head IS NOT NULL").select("head", "n", "every")


@dataclass
class SuffixTree:
    """Root probabilities; per level the states (sorted contexts, share left to the parent) and the kept
    symbols (sorted context-and-symbol keys, own share)."""

    root: np.ndarray
    states: list[tuple[np.ndarray, np.ndarray]]
    entries: list[tuple[np.ndarray, np.ndarray]]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        p = self.root[codes & 0xFF].copy()
        live = np.arange(len(codes))
        for level, ((contexts, left), (keys, share)) in enumerate(zip(self.states, self.entries), start=1):
            gram = codes[live] & ((1 << (8 * (level + 1))) - 1)
            at = np.searchsorted(contexts, gram >> 8)
            found = at < len(contexts)
            found[found] = contexts[at[found]] == gram[found] >> 8
            live, gram, at = live[found], gram[found], at[found]
            if not len(live):
                break
            own = np.searchsorted(keys, gram)
            kept = own < len(keys)
            kept[kept] = keys[own[kept]] == gram[kept]
            value = left[at] * p[live]
            value[kept] += share[own[kept]]
            p[live] = value
        return np.log10(p)


def _nodes(grams_: np.ndarray, c: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(grams_ & ((1 << (8 * (level + 1))) - 1), return_inverse=True)
    return keys, np.bincount(at, c, len(keys))


def build(grams_: np.ndarray, c: np.ndarray, symbols: np.ndarray, heads: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH, least: int = LEAST,
          divergence: float = DIVERGENCE, backing: float = BACKING) -> SuffixTree:
    """The tree of all contexts whose gram counts are given, over the counts of all symbols and, level by level, the
    ``heads`` (sorted keys and counts).  Counts of a context beyond the heads must be complete."""
    total = symbols.sum()
    root = (symbols + 0.5) / (total + 0.5 * SYMBOLS)
    grams_, c = grams_[c > 0], c[c > 0]
    states, entries = [], []
    above, q = np.arange(256), symbols / max(total, 1)
    alive: np.ndarray | None = None
    for level in range(1, depth + 1):
        keys, n_key = heads[level - 1] if level <= len(heads) else _nodes(grams_, c, level)
        contexts, at = np.unique(keys >> 8, return_inverse=True)
        n, back = np.bincount(at, n_key, len(contexts)), backing * np.bincount(at, minlength=len(contexts))
        own = n_key / n[at]
        suffix = np.searchsorted(above, keys & ((1 << (8 * level)) - 1))
        gain = np.bincount(at, n_key * np.log(own / q[suffix]), len(contexts))
        good = (n >= least) & (gain >= divergence)
        if alive is not None:  # a state hangs below a state
            good &= np.isin(contexts & ((1 << (8 * (level - 1))) - 1), alive)
        kept = good[at]
        states.append((contexts[good], (back / (n + back))[good]))
        entries.append((keys[kept], (n_key / (n + back)[at])[kept]))
        above, q, alive = keys, own, contexts[good]
    return SuffixTree(root, states, entries)


def _heads(gram_counts: DataFrame) -> Heads:
    return heads_of(gram_counts.select(F.col("gram").bitwiseAND(F.lit(HEAD)).alias("head"), F.col("c").alias("n"), F.lit(1).alias("every")))


def grow(gram_counts: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, backing: float = BACKING) -> SuffixTree:
    """The whole tree on the driver, for tables of counts that fit there; ``answers`` needs no such place."""
    rows = gram_counts.select("gram", "c").toArrow()
    codes, heads = rows.column("gram").to_numpy(), _heads(gram_counts)
    return build(codes, rows.column("c").to_numpy().astype(float), heads.symbols(), heads.levels(np.unique(_turned(codes, _NEAREST_FIRST) >> 32)), depth, least, divergence, backing)


def answers(sent: DataFrame, heads: Heads, parts: int) -> DataFrame:
    """What blocks sent, with the log10 probability of the symbol of each gram after its context in place of its count,
    and the count over all blocks of each word; and per part of words, as block TOTALS, its distinct training words."""
    shared = sent.sparkSession.sparkContext.broadcast(heads)

    def grown(part: pa.Table) -> list[tuple]:
        rows = list(zip(*(part.column(c).to_pylist() for c in ("block", "part", "size", "keys", "n"))))
        keys, c = _totals((_sorted_keys(k, size), _unpacked(n, size)) for _, _, size, k, n in rows)
        codes = _turned(keys, _SYMBOL_LAST)
        tree = build(codes, c.astype(float), shared.value.symbols(), shared.value.levels(np.unique(keys >> 32)))
        value = tree.log10(codes)
        return [(block, number, size, 0, k, _packed(value[np.searchsorted(keys, _sorted_keys(k, size))])) for block, number, size, k, _ in rows]

    def summed(part: pa.Table) -> list[tuple]:
        rows = list(zip(*(part.column(c).to_pylist() for c in ("block", "part", "size", "length", "keys", "n"))))
        total: dict[bytes, int] = {}
        for _, _, size, length, k, n in rows:
            for w, c in zip(_unpressed(k, length).split(b" "), _unpacked(n, size).tolist()):
                total[w] = total.get(w, 0) + c
        out = [(block, number, size, length, k, _packed(np.array([total[w] for w in _unpressed(k, length).split(b" ")], np.int64))) for block, number, size, length, k, _ in rows]
        return [*out, (TOTALS, rows[0][1], sum(c > 0 for c in total.values()), 0, None, None)]

    def answered(part: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(_ANSWER, (grown if part.column("part")[0].as_py() >= 0 else summed)(part))])

    # packed rows say little of the work they stand for: their number of tasks follows the parts
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(answered, _ANSWER)


def gram_values(gram_counts: DataFrame, part_symbols: int = PART_SYMBOLS) -> DataFrame:
    """(gram, value): log10 probability of the symbol of every gram after its context."""
    heads = _heads(gram_counts)
    parts = heads.parts(part_symbols)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _batch(_SENT, _sent_grams(0, batch.column("gram").to_numpy(), batch.column("c").to_numpy(), parts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, keys, value in zip(*(batch.column(c).to_pylist() for c in ("size", "keys", "value"))):
                yield pa.RecordBatch.from_arrays([pa.array(_turned(_sorted_keys(keys, size), _SYMBOL_LAST)), pa.array(_unpacked(value, size, np.float64))], names=["gram", "value"])

    counts = gram_counts.select(F.col("gram").cast("long").alias("gram"), F.col("c").cast("long").alias("c"))
    return answers(counts.mapInArrow(send, _SENT), heads, parts).mapInArrow(read, "gram long, value double")


def _log10_of(codes: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.argsort(codes)
    codes = codes[order]
    starts = _runs(codes)
    uniques = codes[starts]
    place = np.searchsorted(known, uniques)
    if len(uniques) and (place[-1] >= len(known) or not np.array_equal(known[place], uniques)):
        raise RuntimeError("a gram of a block has no value")
    out = np.empty(len(codes))
    out[order] = np.repeat(value[place], np.diff(starts, append=len(codes)))
    return out


def score(blocks: DataFrame, answered: DataFrame, heads: Heads, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    symbols = heads.symbols()
    n_docs = int(symbols[END])
    n_train = n_docs + int(symbols[ord(" ")])  # a blank closes every word, the mark every document
    least_below = n_train + 0.5

    def scored(block: pa.Table, own: pa.Table) -> pa.Table:
        names = ["key", "n_tokens", "n_known", "base", "score", "distinct"]
        if not len(block):
            one = [pa.nulls(1, block.schema.field("key").type.value_type), *(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            return pa.table([*one, pa.array([sum(own.column("size").to_pylist())], pa.int64())], names=names)
        count = {_MARK: n_docs}
        known, value = [np.empty(0, np.int64)], [np.empty(0)]
        for part, size, length, keys, v in zip(*(own.column(c).to_pylist() for c in ("part", "size", "length", "keys", "value"))):
            if part >= 0:
                known.append(_turned(_sorted_keys(keys, size), _SYMBOL_LAST))
                value.append(_unpacked(v, size, np.float64))
            else:
                count.update(zip(_unpressed(keys, length).split(b" "), _unpacked(v, size).tolist()))
        order = np.argsort(np.concatenate(known))
        known, value = np.concatenate(known)[order], np.concatenate(value)[order]
        out = []
        for batch in block.to_batches():
            for keys, size, body in zip(batch.column("key"), batch.column("size").to_pylist(), batch.column("body").to_pylist()):
                symbols = _unpressed(body, size)
                codes, _ = grams_of(symbols)
                plain = np.frombuffer(symbols, np.uint8)
                # values are summed exactly enough per text in its own window
                starts = _starts(plain)
                sums = np.add.reduceat(_log10_of(codes, known, value), starts)
                sizes = np.add.reduceat((plain == ord(" ")).astype(np.int64), starts) + 1
                words = symbols.replace(_MARK, _MARK + b" ").split()  # the mark stands for the end token
                c = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((c + 0.5) / least_below), starts)
                out.append(pa.RecordBatch.from_arrays([
                    keys.values, pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(base), pa.array(sums), pa.nulls(len(sizes), pa.int64())], names=names))
        return pa.Table.from_batches(out)

    kind = blocks.schema["key"].dataType.elementType.simpleString()
    rows = durable(blocks.select("block", "key", "size", "body").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        scored, f"key {kind}, n_tokens long, n_known long, base double, score double, distinct long"), "scored")
    distinct = (rows.agg(F.sum("distinct").alias("n")).first().n or 0) + (n_docs > 0)
    more = math.log10((n_train + 0.5 * (distinct + 1)) / least_below)
    return rows.filter("distinct IS NULL").select(
        F.col("key").alias(key), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(more)).alias("base_score"), "score")


def train_and_score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_symbols: int = PART_SYMBOLS) -> DataFrame:
    """Learn from the documents where ``training`` holds, score them all."""
    blocks, heads = in_blocks(docs, training, key, text, block_bytes)
    heads = heads_of(heads)
    parts = heads.parts(part_symbols)
    sent = blocks.select("block", "training", "size", "body").mapInArrow(lambda batches: _send(batches, parts), _SENT)
    return score(blocks, answers(sent, heads, parts), heads, key)
