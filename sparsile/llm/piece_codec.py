"""Sentence-piece encoding that keeps source offsets, and decoding.

Normalisation is done here: at every place the longest prefix that the model's compiled character map knows is replaced,
else one character is copied, and for each normalised byte the source byte it stands for is recorded.  Pieces tile
the normalised text, so their running lengths, read through that record, give each piece's span in the original
bytes.  Ids come from the library: where the vocabulary proves that no piece crosses the start of a word, distinct
words are encoded once each, otherwise whole texts are.

Defined results: null counts as empty; an empty text has no pieces and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from sparsile.llm.memo import SequenceMemo, joined
from sparsile.llm.text import cut_by_bytes, raw

# Fixed values of the model format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacements: a double-array trie over UTF-8 and a pool of zero-ended strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest known prefix at ``at``."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class OffsetNormalizer:
    """Normalises as a model file asks for, recording where each byte comes from."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, int]] = []
        spec = {2: b"", 3: 1, 4: 1, 5: 1}
        self.suffix_mark = False
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), piece.get(3, NORMAL)))
            elif number == 2:
                self.suffix_mark = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec |= dict(_fields(value))
        self.map = CharacterMap(spec[2])
        self.identity = not spec[2]
        self.prefix, self.squeeze, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.user = sorted((p.encode() for p, kind in self.pieces if kind == USER), key=len, reverse=True)

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.user:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        found = self.map.longest(data, at)
        if found is not None:
            return found
        lead = data[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source offset."""
        mark = MARK.encode() if self.escape else b" "
        if self.identity and not self.squeeze and not self.user and not self.suffix_mark and data:
            source = np.frombuffer(data, np.uint8)
            wide = np.where(source == 32, len(mark), 1)
            start = len(mark) if self.prefix else 0
            return (mark if self.prefix else b"") + data.replace(b" ", mark), np.concatenate([np.zeros(start, np.int64), np.repeat(np.arange(len(data)), wide), [len(data)]])
        out, origin, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data):
                size, piece = self._next(data, at)
                if piece != b" ":
                    break
                at += size
        if at >= len(data):
            return b"", np.array([0])

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            origin.extend([source] * len(piece))

        if self.prefix and not self.suffix_mark:
            put(mark, at)
        blank = self.squeeze
        while at < len(data):
            size, piece = self._next(data, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", mark), at)
                blank = self.squeeze and piece.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(mark):
                at = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        if self.prefix and self.suffix_mark:
            put(mark, at)
        return bytes(out), np.array([*origin, at])


class PieceCodec:
    """Encoder and decoder of one model file; loaded once per task."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            self.normalizer = OffsetNormalizer(file.read())
        spec, pieces = self.normalizer, self.normalizer.pieces
        self.widths = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in pieces], np.int64)
        self.unknown = np.array([kind == UNKNOWN for _, kind in pieces])
        self.names = [str(i) for i in range(len(pieces))]
        inside = any(MARK in p.lstrip(MARK) for p, kind in pieces if kind in (NORMAL, USER, UNUSED))
        self.by_word = spec.identity and spec.prefix and spec.escape and not spec.squeeze and not spec.suffix_mark and not spec.user and not inside
        # a word's key leaves out the mark before it, which the library puts back
        self.word = re.compile(f"(?:\\A|[ {MARK}])([ {MARK}]*[^ {MARK}]*)")
        self.memo = SequenceMemo(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(words, num_threads=1)
        lone = [self.library.piece_to_id(MARK)]
        return joined([ids if word else lone for word, ids in zip(words, found)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and their number per text."""
        if self.by_word:
            return self.memo.encode([self.word.findall(t) if t else [] for t in texts])
        return joined(self.library.encode(texts, num_threads=1))

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the bytes of the text."""
        normal, origin = self.normalizer.normalize(data)
        widths = self.widths[ids]
        if self.unknown[ids].any():  # a run of characters unknown to the model stands for one id
            pieces = self.library.encode(data.decode(), out_type=str)  # an unknown run is given as its own characters
            widths = np.array([len(p.encode()) if u else w for p, u, w in zip(pieces, self.unknown[ids], widths)], np.int64)
        ends = np.cumsum(widths)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        return origin[ends - widths], origin[ends]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def encode(text: Column, model: str) -> Column:
    """ids, starts and ends (original bytes) of the pieces of each text."""

    @arrow_udf("struct<ids:array<int>, starts:array<int>, ends:array<int>>")
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        kind = pa.struct([(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")])
        for part in parts:
            rows = []
            for piece in cut_by_bytes(part):
                texts = raw(piece)
                ids, per = codec.encode([t.decode() for t in texts])
                for t, own in zip(texts, np.split(ids, np.cumsum(per)[:-1])):
                    starts, ends = codec.spans(t, own)
                    rows.append({"ids": own, "starts": starts, "ends": ends})
            yield pa.array(rows, type=kind)

    return encoded(text)


def decode(ids: Column, model: str) -> Column:
    @arrow_udf("string")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        for part in parts:
            yield pa.array(codec.decode([x or [] for x in part.to_pylist()]), type=pa.string())

    return decoded(ids)


DIGESTS = "struct<n_tokens:long, ids_sha256:string, decoded_sha256:string, spans_crc32:long>"


def round_trip(text: Column, model: str) -> Column:
    """Digests of each text's ids, of what they decode to and of the pieces' spans, without moving the ids themselves."""

    @arrow_udf(DIGESTS)
    def digests(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in parts:
            n_tokens, id_digests, text_digests, span_digests = [], [], [], []
            for piece in cut_by_bytes(part):
                texts = raw(piece)
                ids, per = codec.encode([t.decode() for t in texts])
                own = np.split(ids, np.cumsum(per)[:-1])
                lists = [x.tolist() for x in own]
                n_tokens += per.tolist()
                id_digests += [sha(",".join(map(codec.names.__getitem__, x))) for x in lists]
                text_digests += [sha(t) for t in codec.decode(lists)]
                for t, x in zip(texts, own):
                    starts, ends = codec.spans(t, x)
                    span_digests.append(zlib.crc32(ends.astype("<u4").tobytes(), zlib.crc32(starts.astype("<u4").tobytes())))
            yield pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string()), pa.array(span_digests, pa.int64())],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return digests(text)
