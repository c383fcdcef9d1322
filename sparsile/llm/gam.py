"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of the training sample.  Shallow trees, boosted
feature by feature in turn with a small step, add up to one lookup table per feature; then the
pairs of features that explain most of what is left get two-way tables the same way.  A score is the sum of
table entries through the logistic function: vectorised bin lookups and additions, no tree walks.

Training reads at most ``sample_rows`` labelled rows (a documented bound), those with the smallest hash of
their key; the caller leaves held-out rows out.  Only the text is a feature: labels, language, source
and ids are not.

Defined results: a null, empty or blank text scores 0.0; without labelled rows, or with one class only, the
score is the smoothed share of good rows.  Only the named columns are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from sparsile.llm.labels import labelled_sample
from sparsile.llm.text import BLANKS, Numbers, cut_by_bytes, flat, mixed, per_text, raw, repeated, sizes_of, windows

SAMPLE_ROWS = 6000
MAX_BINS = 48
PAIR_BINS = 8
PAIRS = 6
MEASURES = ["words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "same_next", "distinct_share",
            "repeated_share", "words_per_line", "line_copies", "closed_lines", "wide_share", "short_words"]

_SETS = {"blank": BLANKS, "symbol": b"#*$%&|<>", "mark": b"!?@_=/\\{}[]^~", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
         "wide": bytes(range(0xC0, 0x100)), "follow": bytes(range(0x80, 0xC0))}
_BIT = {name: 1 << i for i, name in enumerate(_SETS)}
_CLASSES = np.zeros(256, np.uint8)
for _name, _members in _SETS.items():
    _CLASSES[list(_members)] |= _BIT[_name]


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of ``MEASURES`` per text."""
    words_of = [t.split() for t in texts]
    words = sizes_of(words_of)
    all_words = flat(words_of)
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, all_words), dtype=np.int64, count=len(all_words))
    lengths = sizes_of(all_words)
    owner = np.repeat(np.arange(len(texts)), words)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    hashes = mixed(ids.astype(np.uint64) + np.uint64(1))
    found, _, per = windows(hashes, words)
    twice = repeated(found ^ mixed(np.repeat(np.arange(len(texts), dtype=np.uint64), per)))
    keys = np.sort(owner * np.int64(max(len(numbers), 1)) + ids)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount(keys[fresh] // max(len(numbers), 1), minlength=len(texts))
    flags = _CLASSES[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = sizes_of(texts)
    count = {name: per_text((flags & bit) != 0, sizes) for name, bit in _BIT.items()}
    chars = np.maximum(sizes - count["blank"] - count["follow"], 1)
    lines_of = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    lines = np.maximum(sizes_of(lines_of), 1)
    copies = lines - np.fromiter((max(len(set(x)), 1) for x in lines_of), np.int64, len(texts))
    closed = np.fromiter((sum(line.rstrip()[-1:] in b".?:\")" for line in x) for x in lines_of), np.int64, len(texts))
    many = np.maximum(words, 1)
    values = {
        "words": words, "word_length": chars / many, "symbol_share": count["symbol"] / chars, "mark_share": count["mark"] / chars,
        "upper_share": count["upper"] / np.maximum(count["upper"] + count["lower"], 1), "digit_share": count["digit"] / chars,
        "same_next": per_text(same, words) / many, "distinct_share": distinct / many, "repeated_share": per_text(twice, per) / np.maximum(per, 1),
        "words_per_line": words / lines, "line_copies": copies / lines, "closed_lines": closed / lines, "wide_share": count["wide"] / chars,
        "short_words": per_text(lengths <= 3, words) / many,
    }
    return np.stack([values[m].astype(float) for m in MEASURES], 1)


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; ``pairs`` holds (feature, feature, table on coarse bins)."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, values[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], values[:, a], side="right"), np.searchsorted(self.coarse[b], values[:, b], side="right")]
        return out

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(values)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _leaf(gradient: float, weight: float) -> float:
    return gradient / (weight + 1.0)


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Greedy tree over the bins of one feature: leaf values per bin, ``leaves`` leaves at most."""
    parts = [(0, len(gradient))]
    sums_g, sums_w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain_of = lambda g, w: g * g / (w + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left_g, left_w = sums_g[at] - sums_g[a], sums_w[at] - sums_w[a]
            right_g, right_w = sums_g[b] - sums_g[at], sums_w[b] - sums_w[at]
            gain = np.where((left_w > 0.5) & (right_w > 0.5), gain_of(left_g, left_w) + gain_of(right_g, right_w) - gain_of(sums_g[b] - sums_g[a], sums_w[b] - sums_w[a]), 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (k, int(at[i])))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = _leaf(sums_g[b] - sums_g[a], sums_w[b] - sums_w[a])
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Best split of a two-way table into four corners: its gain and corner values."""
    sums = lambda x: np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    g, w = sums(gradient), sums(weight)
    best, values = 0.0, np.zeros_like(gradient)
    for i in range(1, gradient.shape[0]):
        for j in range(1, gradient.shape[1]):
            corners = [(x[i, j], x[i, -1] - x[i, j], x[-1, j] - x[i, j], x[-1, -1] - x[i, -1] - x[-1, j] + x[i, j]) for x in (g, w)]
            gain = sum(a * a / (b + 1.0) for a, b in zip(*corners))
            if gain > best:
                best = gain
                a, b, c, d = (_leaf(x, y) for x, y in zip(*corners))
                values = np.zeros_like(gradient)
                values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = a, b, c, d
    return best, values


def fit(values: np.ndarray, labels: np.ndarray, rounds: int = 150, pair_rounds: int = 40, step: float = 0.1, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting on measured rows with labels 0 / 1."""
    good = float(labels.sum())
    base = float(np.log((good + 1) / (len(labels) - good + 1)))
    if not 0 < good < len(labels):
        return AdditiveModel(base)
    n_features = values.shape[1]
    cuts = [_quantile_cuts(values[:, j], MAX_BINS) for j in range(n_features)]
    coarse = [_quantile_cuts(values[:, j], PAIR_BINS) for j in range(n_features)]
    bins = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)]
    low = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(coarse)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    logit = np.full(len(labels), base)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n_features):
            gradient, weight = pull()
            tree = step * _shallow_tree(np.bincount(bins[j], gradient, len(tables[j])), np.bincount(bins[j], weight, len(tables[j])))
            tables[j] += tree
            logit += tree[bins[j]]
    gradient, weight = pull()
    gains = []
    for a in range(n_features):
        for b in range(a + 1, n_features):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = low[a] * shape[1] + low[b]
            size = shape[0] * shape[1]
            gain, _ = _quadrants(np.bincount(cell, gradient, size).reshape(shape), np.bincount(cell, weight, size).reshape(shape))
            gains.append((gain, a, b, cell, shape))
    chosen = [[a, b, cell, np.zeros(shape)] for _, a, b, cell, shape in sorted(gains, key=lambda x: (-x[0], x[1], x[2]))[:pairs]]
    for _ in range(pair_rounds):
        for pair in chosen:
            gradient, weight = pull()
            shape = pair[3].shape
            _, corner = _quadrants(np.bincount(pair[2], gradient, pair[3].size).reshape(shape), np.bincount(pair[2], weight, pair[3].size).reshape(shape))
            pair[3] = pair[3] + step * corner
            logit += step * corner.ravel()[pair[2]]
    return AdditiveModel(base, cuts, tables, coarse, [(a, b, table) for a, b, _, table in chosen])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the ``sample_rows`` labels with the smallest hash of their key."""
    sample = labelled_sample(docs, labels, text, label, key, sample_rows)
    values = [measure(raw(piece)) for piece in cut_by_bytes(sample.column("text"))]
    return fit(np.concatenate(values) if values else np.zeros((0, len(MEASURES))), np.array(sample.column("label").to_pylist(), dtype=float))


def score(text: Column, model: AdditiveModel) -> Column:
    """P(label 1) of each text."""

    @arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = [np.zeros(0)]
            for piece in cut_by_bytes(part):
                values = measure(raw(piece))
                out.append(np.where(values[:, 0] > 0, model.score(values), 0.0))
            yield pa.array(np.concatenate(out))

    return scored(text)
