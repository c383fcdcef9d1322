"""Batch helpers on texts: words, byte classes and shingle hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Words are runs of anything but these six ASCII characters; bytes.split() cuts at the same ones.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BATCH_BYTES = 4_000_000
SHINGLE_WORDS = 5
MEMO_WORDS = 400_000
# Odd 64-bit multipliers, one per place of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def cut_by_bytes(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of a text column of about ``limit`` bytes each; a longer text stands alone."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield column.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs of the given sizes (empty runs give 0)."""
    upto = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=upto[1:])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def sizes_of(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), dtype=np.int64, count=len(items))


class Numbers(dict):
    """Numbers words 0, 1, … in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Hashes(dict):
    """64-bit hashes of words; emptied when it has grown to ``MEMO_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 42)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


def flat(lists: list[list]) -> list:
    return [x for part in lists for x in part]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside each text, the start of each
    window among ``words`` and the number of windows of each text."""
    n = len(words) - width + 1
    per = np.maximum(counts - width + 1, 0)
    if n <= 0 or not per.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64), per
    sums = words[:n] * PLACES[0]
    for place in range(1, width):
        sums += words[place : place + n] * PLACES[place % len(PLACES)]
    firsts = np.cumsum(counts) - counts
    starts = np.arange(per.sum()) + np.repeat(firsts - (np.cumsum(per) - per), per)
    return mixed(sums[starts]), starts, per


def shingle_hashes(texts: list[bytes], memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word windows of each text, repeats included, and their number.

    A text of fewer words than a window has one shingle, of all its words; a text
    without words has none.
    """
    lists = [t.split() for t in texts]
    for words in lists:
        if 0 < len(words) < SHINGLE_WORDS:
            words.extend([b""] * (SHINGLE_WORDS - len(words)))
    counts = sizes_of(lists)
    total = int(counts.sum())
    hashes = np.fromiter(map(memo.__getitem__, flat(lists)), dtype=np.uint64, count=total)
    found, _, per = windows(hashes, counts)
    return found, per


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    codes, _ = pd.factorize(values)
    return np.bincount(codes)[codes] > 1 if len(codes) else np.zeros(0, bool)
