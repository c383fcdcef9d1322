"""Phrase collocations by prefix-free parsing.

Texts (A to Z lower-cased) are split at punctuation and line ends into pieces, pieces at blanks and tabs into words.  A window of
``LONGEST`` - 1 words whose hash is 0 modulo ``TRIGGER`` starts a new chunk; the chunk before it ends behind that window,
so neighbouring chunks overlap by the window.  Cuts depend on content only, hence a passage that many documents share
falls into the same chunks everywhere, and the dictionary of distinct chunks, with their parse frequencies, is much smaller
than the text.  n-grams are counted inside distinct chunks, weighted by frequency.  One that starts in the overlap
belongs to the next chunk, where it is whole; so every occurrence is counted once.

Counts go up from words to the longest phrases.  An n-gram can only be as frequent as both n-grams of one word less inside
it, so it is counted only if both may have reached the minimum: their hashes are looked up in a table of ``MARKS`` bits.
The table has a fixed size; as it fills up it lets more n-grams through to the count, and results stay exact.

Scores are exact (decimals of 38 digits).  Everything is per language; null is ``und``.

Defined results: null counts as empty; pieces without words count nothing; very long texts are parsed in parts of about ``PART_BYTES``, cut
between pieces only; repeated rows count as often as they stand there; ties are in the order of the contract (score, a,
then the phrase in byte order); an empty table gives no rows; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.llm.text import Hashes, cut_by_bytes, flat, mixed, raw, sizes_of, windows
from sparsile.session import durable
from sparsile.sizing import local_copy

LONGEST = 5
LEAST = 100
TOP = 2000
TRIGGER = 16
SHRINK = 3  # from this length on, chunks without an n-gram to count are left out
MARKS = 1 << 26
PART_BYTES = 1 << 20
BATCH_BYTES = 2_000_000
NO_LANG = "und"

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER_AND_CUT = bytes(0x0A if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---- parsing ---------------------------------------------------------------

def pieces_of(text: bytes, size: int = PART_BYTES) -> Iterator[list[list[bytes]]]:
    """The words of each piece of a text, in lists of pieces of about ``size`` bytes."""
    text = text.translate(_LOWER_AND_CUT)
    start = 0
    while start < len(text):
        stop = text.find(b"\n", start + size)
        stop = len(text) if stop < 0 else stop
        yield [w for w in map(bytes.split, text[start:stop].split(b"\n")) if w]
        start = stop


def chunk_bounds(hashes: np.ndarray, sizes: np.ndarray, overlap: int = LONGEST - 1, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, last) of the chunks of consecutive pieces, given the hashes of their words."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    found, starts, _ = windows(hashes, sizes, overlap)
    cuts = np.union1d(firsts, starts[found % np.uint64(trigger) == 0])
    piece_end = ends[np.searchsorted(firsts, cuts, side="right") - 1]
    following = np.append(cuts[1:], ends[-1])
    last = following >= piece_end
    return cuts, np.where(last, piece_end, following + overlap), last


def _chunks(longest: int, trigger: int):
    """Arrow batches of (text, lang) to (lang, chunk, last, n), summed within a batch."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for batch in batches:
            at = 0
            for part in cut_by_bytes(batch.column(0), BATCH_BYTES):
                langs = batch.column(1).slice(at, len(part)).to_pylist()
                at += len(part)
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs, raw(part)):
                    by_lang.setdefault(NO_LANG if lang is None else lang, []).append(text)
                for lang, texts in by_lang.items():
                    gathered, held = [], 0
                    for pieces in (p for t in texts for p in pieces_of(t)):
                        gathered += pieces
                        held += sum(map(len, pieces))
                        if held > BATCH_BYTES // 4:
                            yield from cut(lang, gathered, memo)
                            gathered, held = [], 0
                    yield from cut(lang, gathered, memo)

    def cut(lang: str, pieces: list[list[bytes]], memo: Hashes) -> Iterator[pa.RecordBatch]:
        if not pieces:
            return
        words = flat(pieces)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        starts, ends, last = chunk_bounds(hashes, sizes_of(pieces), longest - 1, trigger)
        counts = Counter((b" ".join(words[s:e]), x) for s, e, x in zip(starts.tolist(), ends.tolist(), last.tolist()))
        chunks, lasts = zip(*counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chunks)), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(lasts), pa.array(list(counts.values()), pa.int64())],
                                         names=["lang", "chunk", "last", "n"])

    return parse


# ---- counting --------------------------------------------------------------

class Words:
    """The words of some rows of one language, as numbers of their distinct words."""

    def __init__(self, lang: str, column: pa.Array) -> None:
        self.lang = lang
        lists = pc.split_pattern(column, " ")
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.distinct, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams inside rows, per language, and where they start."""
        each = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(self.distinct))
        found, starts, _ = windows(each[self.code], self.sizes, width)
        return mixed(found ^ np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), 42))), starts

    def labels(self, at: np.ndarray, width: int) -> np.ndarray:
        """A number for the n-gram at each place, equal for equal n-grams only."""
        label = self.code[at]
        for j in range(1, width):
            label = pd.factorize(label * np.int64(len(self.distinct)) + self.code[at + j])[0].astype(np.int64)
        return label

    def texts(self, at: np.ndarray, width: int) -> pa.Array:
        words = [self.distinct.take(pa.array(self.code[at + j])) for j in range(width)]
        return pc.binary_join_element_wise(*words, " ") if width > 1 else words[0]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_BYTES``, so that more equal n-grams meet."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _by_language(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, Words]]:
    """(row numbers, words) of a batch's rows by language, of up to about ``BATCH_BYTES`` each."""
    lang = batch.column(0).dictionary_encode()
    codes = lang.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(lang.dictionary.to_pylist()):
        rows, at = np.flatnonzero(codes == code), 0
        for part in cut_by_bytes(batch.column(column).take(pa.array(rows)), BATCH_BYTES):
            yield rows[at : at + len(part)], Words(name, part)
            at += len(part)


def _places(words: Words, last: np.ndarray, width: int, longest: int, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the n-grams of ``width`` words to be counted: they start before their chunk's overlap, end inside the
    chunk, and both n-grams of one word less inside them are marked."""
    sizes, ends = words.sizes, np.cumsum(words.sizes)
    per = np.maximum(np.minimum(sizes - np.where(last, 0, longest - 1), sizes - width + 1), 0)
    row = np.repeat(np.arange(len(sizes)), per)
    at = np.arange(len(row)) + (ends - sizes - np.cumsum(per) + per)[row]
    if marks is None or not len(at):
        return row, at
    frequent = np.zeros(len(words.code), dtype=bool)
    found, where = words.hashes(width - 1)
    frequent[where] = marked(marks, found)
    good = frequent[at] & frequent[at + 1]
    return row[good], at[good]


def _grams(width: int, longest: int, marks: np.ndarray | None):
    """Distinct chunks (lang, chunk, last, n) to weighted counts (lang, gram, n) of their n-grams, summed within a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            lasts, weights = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for rows, words in _by_language(batch, 1):
                row, at = _places(words, lasts[rows], width, longest, marks)
                if not len(at):
                    continue
                number, _ = pd.factorize(words.labels(at, width))
                first = np.empty(number.max() + 1, np.int64)
                first[number[::-1]] = at[::-1]
                totals = np.zeros(len(first), np.int64)
                np.add.at(totals, number, weights[rows][row])
                yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(first)), words.texts(first, width), pa.array(totals)], names=["lang", "gram", "n"])

    return count


def _holding(width: int, longest: int, marks: np.ndarray):
    """The chunks that hold an n-gram of ``width`` words to be counted; the others hold no longer one either."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            lasts = batch.column(2).to_numpy(zero_copy_only=False)
            found = [rows[np.unique(_places(words, lasts[rows], width, longest, marks)[0])] for rows, words in _by_language(batch, 1)]
            if found:
                yield batch.take(pa.array(np.concatenate(found)))

    return keep


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(len(marks) * 8)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _mark_table(grams: DataFrame, width: int, bits: int = MARKS) -> np.ndarray:
    """A table of ``bits`` bits with those of all given n-grams set.  At most ``bits`` / 64 rows reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _by_language(batch, 1):
                found, _ = words.hashes(width)
                yield pa.RecordBatch.from_arrays([pa.array((found % np.uint64(bits)).astype(np.int64))], names=["slot"])

    word = F.shiftrightunsigned("slot", 6)
    found = grams.select("lang", "gram").mapInArrow(slots, "slot long").groupBy(word.alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of the parse and how often each occurs; ``last`` ones end their piece."""
    rows = docs.select(F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(_chunks(longest, trigger), "lang string, chunk string, last boolean, n long").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def frequent_grams(chunks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """[(lang, gram, n) per length]: n-grams of up to ``longest`` words with at least ``least``
    occurrences, and (lang, n) with the number of all words."""
    counted: list[DataFrame] = []
    marks, totals = None, None
    for width in range(1, longest + 1):
        if width == SHRINK:
            chunks = durable(chunks.mapInArrow(_holding(width, longest, marks), chunks.schema), "holding")
        found = chunks.mapInArrow(_grams(width, longest, marks), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        if width == 1:
            found = durable(found, "words")
            totals = found.groupBy("lang").agg(F.sum("n").alias("n"))
        else:
            found = durable(found.filter(F.col("n") >= least), "grams")
        counted.append(found.filter(F.col("n") >= least))
        if width < longest:
            marks = _mark_table(counted[-1], width)
            if not marks.any():
                break
    return counted, totals


# ---- scores ----------------------------------------------------------------

def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP, longest: int = LONGEST, percent: int = 100,
         trigger: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases (None: all)."""
    chunks = durable(dictionary(docs, text, lang, longest, trigger), "chunks")
    counted, totals = frequent_grams(chunks, longest, least)
    known = reduce(DataFrame.unionByName, counted).select("lang", F.col("gram").alias("part"), F.col("n").alias("f"))
    levels = [(k + 1, g) for k, g in enumerate(counted) if k]
    if not levels:  # no word is frequent
        empty = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], empty)
    candidates = reduce(DataFrame.unionByName, [g.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.lit(k).alias("k")) for k, g in levels])
    words = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")

    # a phrase goes if a longer candidate with as many occurrences holds it
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: joined(i, m))))
    held = candidates.filter("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").filter(f"longer IS NULL OR {percent} * CAST(longer AS DECIMAL(38,0)) < 100 * CAST(a AS DECIMAL(38,0))").drop("longer")

    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k").select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    with_l = cuts.join(known.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    few = local_copy(totals)  # one row per language
    both = with_l.join(known.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]).join(totals if few is None else F.broadcast(few), "lang")
    score = F.expr("CAST(1000 * CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(34,0)) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))").cast("long")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
