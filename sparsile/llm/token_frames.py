"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds documents in key order:

* data frames: ids of whole documents, little-endian, ``FRAME_TOKENS`` or so per frame, each frame with its own
  content checksum and readable alone;
* a skippable frame with the document index: key, number of tokens and frame of every document;
* a skippable frame in the public seekable format: compressed size, decompressed size and checksum of every
  frame, then the footer that a reader finds from the end of the file.

A plain zstandard reader decompresses the whole file; ``read_documents`` fetches only the frames it needs.  Files are
written by executors into the shared folder under a private name and renamed when complete, so a retried
or doubled task leaves one whole file.

Defined results: null counts as empty; an empty text has the end id only; null keys come first; rows of one key are
ordered by a hash of their text and may stand in several files, equal rows stay side by side; texts of any length are encoded whole; further
columns are ignored, whatever their names; an empty table gives no file and no row.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.llm.memo import SequenceMemo, joined, kept
from sparsile.llm.text import cut_by_bytes, raw
from sparsile.session import durable, fresh_path

END_ID = 2
FRAME_TOKENS = 65_536
# Fixed values of the zstandard frame formats.
SEEK_FRAME, INDEX_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

# White space as the tokenizer's own pattern sees it (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0  -     　"
# A word with at most one blank before it; or a run of white space, without its last character if a word follows.
# Byte-level pre-tokenization never joins characters across these pieces, so they can be encoded one by one.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


# The byte-level pre-tokenizer's pattern inside one such piece, and its printable stand-ins for bytes (fixed values).
_INNER = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_INS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class BytePieceEncoder:
    """Encodes texts with a tokenizer file.  Under plain byte-level pre-tokenization each distinct piece goes to the
    library's model once while it is kept; texts with the string of an added token go to the library whole, as all texts do for any other tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        # strings of added tokens are found in the whole text before anything is cut
        self.added = sorted({t["content"] for t in form.get("added_tokens") or []} - {""})
        cut = form["pre_tokenizer"] or {}
        self.by_piece = (form["normalizer"] is None and form["model"].get("type", "BPE") == "BPE" and cut.get("type") == "ByteLevel"
                         and not cut.get("add_prefix_space", True) and cut.get("use_regex", True))
        self.words = SequenceMemo(self._encode_pieces, self._cut)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, blank = self.tokenizer.model.tokenize, chr(_STAND_INS[32])
        shown = [p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_STAND_INS) for p in pieces]
        return joined([[t.id for t in tokenize(p)] for p in shown])

    @staticmethod
    def _cut(word: str) -> list[str] | None:
        if word.isalpha() or (word[0] == " " and word[1:].isalpha()):  # one piece of the pattern
            return None
        parts = _INNER.findall(word)
        return parts if len(parts) > 1 else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and their number per text.  Pieces come and go by the million and hold no cycles, so the
        collector of cycles, which would walk through all known pieces, rests meanwhile."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts) if self.by_piece else self._whole(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        marked = set(special)
        ids, per = self.words.encode([[] if i in marked else _PIECE.findall(t) for i, t in enumerate(texts)])
        if not special:
            return ids, per
        parts = np.split(ids, np.cumsum(per)[:-1])
        own, sizes = self._whole([texts[i] for i in special])
        for i, part in zip(special, np.split(own, np.cumsum(sizes)[:-1])):
            parts[i] = part
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)])


def encoder_of(path: str) -> BytePieceEncoder:
    """The worker's encoder for a tokenizer file as it is now; its known pieces serve later tasks too."""
    state = os.stat(path)
    return kept(("BytePieceEncoder", path, state.st_mtime_ns, state.st_size), lambda: BytePieceEncoder(path))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; ``add`` takes a document's ids, ``close`` adds the index and the seek table."""

    def __init__(self, sink, width: int, frame_tokens: int = FRAME_TOKENS, level: int = 1) -> None:
        self.sink, self.kind, self.frame_tokens = sink, np.dtype(f"<u{width}"), frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.places: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.places.append(len(self.frames))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.frame_tokens:
            self._flush()

    def _flush(self) -> None:
        data = np.concatenate(self.held).astype(self.kind).tobytes()
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        known = np.array([k is not None for k in self.keys], np.uint8)
        body = struct.pack("<BQ", self.kind.itemsize, len(keys)) + self.zstd.compress(
            keys.tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.places, "<u4").tobytes())
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        entries = np.array([*self.frames, (len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)


@dataclass
class FrameFile:
    """An open file with its seek table and document index."""

    source: pa.NativeFile
    sizes: np.ndarray  # frame: compressed size, decompressed size, checksum
    kind: np.dtype
    keys: list[int | None]
    counts: np.ndarray
    places: np.ndarray

    @classmethod
    def open(cls, source: pa.NativeFile) -> FrameFile:
        length = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, length - 9))
        if magic != SEEK_FOOTER or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, length - 9 - 12 * n), "<u4").reshape(n, 3)
        at = int(table[:-1, 0].sum(dtype=np.int64))
        width, docs = struct.unpack("<BQ", source.read_at(9, at + 8))
        body = zstandard.ZstdDecompressor().decompress(source.read_at(int(table[-1, 0]) - 17, at + 17))
        keys, known = np.frombuffer(body, "<i8", docs).tolist(), np.frombuffer(body, np.uint8, docs, 8 * docs)
        return cls(source, table[:-1], np.dtype(f"<u{width}"), [k if ok else None for k, ok in zip(keys, known)],
                   np.frombuffer(body, "<u8", docs, 9 * docs).astype(np.int64), np.frombuffer(body, "<u4", docs, 17 * docs).astype(np.int64))

    def frame(self, number: int) -> np.ndarray:
        """The ids of one frame; both checksums are verified."""
        packed, size, checksum = (int(x) for x in self.sizes[number])
        at = int(self.sizes[:number, 0].sum(dtype=np.int64))
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(data, self.kind)

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(key, ids) in file order, of all documents or of the ``wanted`` keys; frames without one are not read."""
        firsts = np.searchsorted(self.places, np.arange(len(self.sizes)), side="left")
        stops = np.append(firsts[1:], len(self.places))
        for number, (a, b) in enumerate(zip(firsts.tolist(), stops.tolist())):
            if wanted is not None and wanted.isdisjoint(self.keys[a:b]):
                continue
            ids = self.frame(number)
            ends = np.cumsum(self.counts[a:b])
            for i in range(a, b):
                if wanted is None or self.keys[i] in wanted:
                    yield self.keys[i], ids[ends[i - a] - self.counts[i] : ends[i - a]]


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode documents and write them in key order; returns the manifest, one row per file, in order of ``part``.
    Texts move once, to the range of keys whose file holds them; rows of one key are cut by a hash of their text."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    ordered = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), F.xxhash64("body")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, total, sink = encoder_of(tokenizer), None, 0, None
        files, base = open_folder(folder)
        part = TaskContext.get().partitionId()
        draft, final = f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}.ids.zst"
        for batch in batches:
            at = 0
            for piece in cut_by_bytes(batch.column("body")):
                keys = batch.column("key").slice(at, len(piece)).to_pylist()
                at += len(piece)
                ids, per = encoder.encode([t.decode() for t in raw(piece)])
                if writer is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(draft)
                    writer = FrameWriter(sink, 2 if max(encoder.tokenizer.get_vocab_size(), end_id) < 1 << 16 else 4)
                for k, stop, n in zip(keys, np.cumsum(per).tolist(), per.tolist()):
                    writer.add(k, np.append(ids[stop - n : stop], end_id))
                total += len(ids) + len(per)
        if writer is not None:
            writer.close()
            sink.close()
            files.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.ids.zst"], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return durable(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files one task per file."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = files.select("path", "start").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = open_folder(path)
                with store.open_input_file(name) as source:
                    file = FrameFile.open(source)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()]
                starts = start + np.cumsum(file.counts) - file.counts
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.keys, pa.int64()), "start": starts, "n_tokens": file.counts, "ids_crc32": pa.array(crcs, pa.int64())})

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the given keys; only frames that hold one of them are decompressed."""
    wanted = set(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = open_folder(path)
                with store.open_input_file(name) as source:
                    found = list(FrameFile.open(source).documents(wanted))
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in found], pa.int64()), "ids": pa.array([i.astype(np.int64) for _, i in found], pa.list_(pa.int64()))})

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, ids array<long>")
