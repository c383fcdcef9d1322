"""Encoding by distinct pieces of text: a piece is encoded once for as long as it is kept."""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import chain
from types import ModuleType

import numpy as np

from sparsile.llm.text import flat, per_text, sizes_of

MEMO_PIECES = 450_000


class _Numbered(dict):
    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists in a row, and the length of each."""
    lengths = sizes_of(lists)
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(lengths.sum())), lengths


def kept[T](key: tuple, make: Callable[[], T]) -> T:
    """One object per ``key`` and Python worker, from task to task as Spark reuses its workers.  Functions travel by
    value, so a module of this package would be new in every task; a module of the worker's own holds it."""
    shelf = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__.setdefault("objects", {})
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


class SequenceMemo:
    """Ids of texts that are cut into independent pieces.  Beyond ``limit`` known pieces, those met only once
    since the last time are forgotten, or all if more than half the limit would stay.
    ``encode_many`` gives the ids of pieces in a row and the number of each; ``cut`` gives the smaller pieces of which a
    piece is made, or None if it is to be encoded as it is."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[str], list[str] | None] | None = None, limit: int = MEMO_PIECES) -> None:
        self.encode_many, self.cut, self.limit = encode_many, cut, limit
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbered()
        self.ids, self.lengths, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.seen = np.empty(0, np.int64)

    def _trim(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.limit // 2:
            return self._reset()
        names = list(self.numbers)  # in order of their numbers
        self.numbers = _Numbered()
        self.numbers.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        self.ids, self.lengths = self._gather(keep)
        self.starts, self.seen = np.cumsum(self.lengths) - self.lengths, np.ones(len(keep), np.int64)

    def _put(self, places: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts[places], self.lengths[places] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        self.ids = np.concatenate([self.ids, ids])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces in a row, and the number of each."""
        lengths = self.lengths[numbers]
        return self.ids[np.arange(int(lengths.sum())) + np.repeat(self.starts[numbers] - (np.cumsum(lengths) - lengths), lengths)], lengths

    def _learn(self) -> None:
        fresh, base = self.numbers.fresh, len(self.starts)
        self.numbers.fresh = []
        inner = {} if self.cut is None else {base + i: parts for i, w in enumerate(fresh) if (parts := self.cut(w)) is not None}
        per = sizes_of(list(inner.values()))
        parts = self._numbered(flat(list(inner.values())))
        more = self.numbers.fresh
        self.numbers.fresh = []
        room = len(self.numbers) - base
        self.starts, self.lengths = np.append(self.starts, np.zeros(room, np.int64)), np.append(self.lengths, np.zeros(room, np.int64))
        self.seen = np.append(self.seen, np.zeros(room, np.int64)) + np.bincount(parts, minlength=base + room)
        whole = [n for n in range(base, base + len(fresh)) if n not in inner]
        self._put(np.array([*whole, *range(base + len(fresh), base + room)], np.int64), *self.encode_many([*(fresh[n - base] for n in whole), *more]))
        if inner:
            ids, lengths = self._gather(parts)
            self._put(np.array(list(inner), np.int64), ids, per_text(lengths, per))

    def _numbered(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and their number per text."""
        numbers = self._numbered(flat(pieces))
        if self.numbers.fresh:
            self._learn()
        ids, lengths = self._gather(numbers)
        self.seen += np.bincount(numbers, minlength=len(self.seen))
        if len(self.numbers) > self.limit:
            self._trim()
        return ids, per_text(lengths, sizes_of(pieces))
