"""Line labels from a linear-chain conditional random field.

Every line of a text is content or boilerplate.  Line features vote with learned weights,
neighbouring labels with learned transitions; Viterbi decoding gives the best labelling of the
whole text, and the share of words on content lines decides whether the text is kept.

The weights are trained here on at most ``sample_rows`` labelled documents (a documented bound;
nothing else of the corpus enters the model).  Labels are per document, so training starts with
all lines of a bad document as boilerplate and then, for ``rounds`` rounds, lets the model move those
of its lines to content that it finds clean.

Defined results: a null or empty text has no words and is not kept; lines without a word are
labelled but carry no weight in the share; with no labelled rows the weights are zero and every
line is content.  Only the text column is read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from sparsile.llm.labels import labelled_sample
from sparsile.llm.text import BLANKS, Numbers, cut_by_bytes, flat, per_text, raw, repeated, sizes_of, windows, mixed

CONTENT, BOILERPLATE = 0, 1
SAMPLE_ROWS = 3000
MIN_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

# byte classes
BLANK, SYMBOL, UPPER, LOWER, DIGIT, LEAD, MARK = (1 << i for i in range(7))
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(BLANKS)] |= BLANK
CLASSES[list(SYMBOLS)] |= SYMBOL
CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] |= UPPER
CLASSES[list(b"abcdefghijklmnopqrstuvwxyz")] |= LOWER
CLASSES[list(b"0123456789")] |= DIGIT
CLASSES[list(b"!?@_=/\\{}[]^~")] |= MARK
CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= LEAD

# Cut points of the line measures; each measure becomes one indicator per interval.
CUTS = {
    "words": [1, 3, 6, 12, 25],
    "symbol_share": [0.005, 0.03, 0.1],
    "mark_share": [0.005, 0.03, 0.1],
    "upper_share": [0.05, 0.2, 0.6],
    "digit_share": [0.02, 0.1, 0.3],
    "same_next": [0.01, 0.1, 0.4],
    "repeated_share": [0.01, 0.2, 0.6],
    "word_length": [2.0, 4.0, 7.0, 12.0],
    "copy": [0.5],
    "closed": [0.5],
}
FEATURES = sum(len(c) + 1 for c in CUTS.values())


@dataclass
class Lines:
    """Lines of a batch of texts, with measures of each line and of each text."""

    per: np.ndarray  # lines per text
    words: np.ndarray  # words per line
    indicators: np.ndarray  # line x measure: row of the weight table
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _copies(lines: list[list[bytes]], words: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    out = np.zeros(len(words), bool)
    at = 0
    for part in lines:
        if len(part) > 1 and len(set(part)) < len(part):
            seen: set[bytes] = set()
            for offset, line in enumerate(part):
                out[at + offset] = line in seen
                seen.add(line)
        at += len(part)
    return out & (words > 0)


def read_lines(texts: list[bytes]) -> Lines:
    """Split texts at newlines and measure every line."""
    lines = [t.split(b"\n") for t in texts]
    per = sizes_of(lines)
    flat_lines = flat(lines)
    words_of = [x.split() for x in flat_lines]
    words = sizes_of(words_of)
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, flat(words_of)), dtype=np.int64, count=int(words.sum()))
    text_words = per_text(words, per)

    # repeated windows, inside each text
    hashes = mixed(ids.astype(np.uint64) + np.uint64(1))
    found, starts, windows_per = windows(hashes, text_words)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), windows_per)
    covered = np.zeros(len(ids) + 5, bool)
    twice = starts[repeated(found ^ mixed(owner))]
    for place in range(5):
        covered[twice + place] = True
    covered = covered[: len(ids)]

    same = np.zeros(len(ids), bool)
    same[1:] = ids[1:] == ids[:-1]
    if len(ids):
        firsts = (np.cumsum(words) - words)[words > 0]
        same[firsts] = False
    flags = CLASSES[np.frombuffer(b"".join(flat_lines), np.uint8)]
    sizes = sizes_of(flat_lines)

    def count(bit: int) -> np.ndarray:
        return per_text((flags & bit) != 0, sizes)

    chars = per_text(((flags & LEAD) != 0) & ((flags & BLANK) == 0), sizes)
    symbols, upper, lower = count(SYMBOL), count(UPPER), count(LOWER)
    copies = _copies(lines, words)
    some, many = np.maximum(chars, 1), np.maximum(words, 1)
    closed = np.fromiter((x.rstrip()[-1:] in (b".", b"?", b":", b'"', b")") for x in flat_lines), dtype=bool, count=len(flat_lines))
    measures = {
        "words": words, "symbol_share": symbols / some, "mark_share": count(MARK) / some, "upper_share": upper / np.maximum(upper + lower, 1),
        "digit_share": count(DIGIT) / some, "same_next": per_text(same, words) / many, "repeated_share": per_text(covered, words) / many,
        "word_length": chars / many, "copy": copies, "closed": closed,
    }
    columns, at = [], 0
    for name, cuts in CUTS.items():
        columns.append(at + np.searchsorted(cuts, measures[name], side="right"))
        at += len(cuts) + 1
    return Lines(per, words, np.stack(columns, 1), text_words, per_text(chars, per), per_text(symbols, per), per_text(copies, per), per_text(covered, text_words))


@dataclass
class ChainModel:
    """Weights of boilerplate against content: per indicator, for the label of the line
    before (two rows of a transition table) and for the first line."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2, log potentials
    first: np.ndarray  # 2

    def votes(self, indicators: np.ndarray) -> np.ndarray:
        out = np.zeros((len(indicators), 2))
        out[:, BOILERPLATE] = self.weights[indicators].sum(1)
        return out


def _layout(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts by falling number of lines, their first line, and how many texts still
    have a line at each position: texts then run in lockstep."""
    order = np.argsort(-per, kind="stable")
    sizes = per[order]
    firsts = (np.cumsum(per) - per)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    return order, firsts, active


def viterbi(model: ChainModel, indicators: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The most likely labels of all lines; ties go to content."""
    votes = model.votes(indicators)
    labels = np.zeros(len(votes), np.int8)
    if not len(votes):
        return labels
    _, firsts, active = _layout(per)
    back = np.zeros((len(votes), 2), np.int8)
    score = model.first + votes[firsts]
    for t in range(1, len(active)):
        n = active[t]
        at = firsts[:n] + t
        via = score[:n, :, None] + model.moves
        best = (via[:, 1] > via[:, 0]).astype(np.int8)
        back[at] = best
        score[:n] = np.where(best == 1, via[:, 1], via[:, 0]) + votes[at]
    state = (score[:, 1] > score[:, 0]).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = firsts[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def _expectations(model: ChainModel, votes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: P(boilerplate) of each line, expected moves and first labels."""
    _, firsts, active = _layout(per)
    ahead, behind = np.zeros((len(votes), 2)), np.zeros((len(votes), 2))
    ahead[firsts] = model.first + votes[firsts]
    for t in range(1, len(active)):
        at = firsts[: active[t]] + t
        ahead[at] = np.logaddexp(ahead[at - 1, :1] + model.moves[0], ahead[at - 1, 1:] + model.moves[1]) + votes[at]
    for t in range(len(active) - 1, 0, -1):
        at = firsts[: active[t]] + t
        after = votes[at] + behind[at]
        behind[at - 1] = np.logaddexp(model.moves[:, 0] + after[:, :1], model.moves[:, 1] + after[:, 1:])
    both = ahead + behind
    whole = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both[:, 1] - whole)
    inner = np.ones(len(votes), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    moves = np.exp(ahead[at - 1, :, None] + model.moves + (votes[at] + behind[at])[:, None, :] - whole[at, None, None]).sum(0)
    return p, moves, np.array([(1 - p[firsts]).sum(), p[firsts].sum()])


def fit_chain(indicators: np.ndarray, per: np.ndarray, labels: np.ndarray, steps: int = 80, penalty: float = 1e-4) -> ChainModel:
    """Maximise the conditional likelihood of ``labels`` by adaptive gradient steps."""
    model = ChainModel(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    if not len(labels):
        return model
    firsts = np.cumsum(per) - per
    inner = np.ones(len(labels), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (labels[at - 1], labels[at]), 1)
    seen_first = np.bincount(labels[firsts], minlength=2)
    theta = np.zeros(FEATURES + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = ChainModel(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])
        p, moves, first = _expectations(model, model.votes(indicators), per)
        residual = np.repeat(labels - p, indicators.shape[1])
        gradient = np.concatenate([np.bincount(indicators.ravel(), residual, FEATURES), (seen_moves - moves).ravel(), seen_first - first]) / len(labels) - penalty * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return ChainModel(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, rounds: int = 2) -> ChainModel:
    """Train on the ``sample_rows`` labels with the smallest hash of their key."""
    sample = labelled_sample(docs, labels, text, label, key, sample_rows)
    lines = read_lines(raw(sample.column("text")))
    bad = np.repeat(np.array(sample.column("label").to_pylist(), dtype=np.int64) == 0, lines.per)
    marks = bad.astype(np.int64)
    model = fit_chain(lines.indicators, lines.per, marks)
    for _ in range(rounds):
        marks = (bad & (viterbi(model, lines.indicators, lines.per) == BOILERPLATE)).astype(np.int64)
        model = fit_chain(lines.indicators, lines.per, marks)
    return model


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_lines long, "
          "boilerplate_lines long, content_share double")


def label_lines(text: Column, model: ChainModel) -> Column:
    """Measures, line counts by label and the content share of each text."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    @arrow_udf("struct<" + RESULT.replace(" ", ":").replace(",:", ", ") + ">")
    def labelled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out: list[pa.Array] = []
            for piece in cut_by_bytes(part):
                lines = read_lines(raw(piece))
                content = viterbi(model, lines.indicators, lines.per) == CONTENT
                kept = per_text(content, lines.per)
                share = per_text(content * lines.words, lines.per) / np.maximum(lines.n_words, 1)
                values = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, kept, lines.per - kept, share]
                out.append(pa.StructArray.from_arrays([pa.array(v) for v in values], names=names))
            yield pa.concat_arrays(out) if out else pa.array([], type=pa.struct([(n, pa.float64() if n == "content_share" else pa.int64()) for n in names]))

    return labelled(text)


def line_spans(text: Column, model: ChainModel) -> Column:
    """Array of (start, end, label) of the lines of each text, in code points."""

    @arrow_udf("array<struct<start:long, end:long, content:boolean>>")
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("content", pa.bool_())]))
        for part in parts:
            rows = []
            for piece in cut_by_bytes(part):
                texts = raw(piece)
                lines = read_lines(texts)
                content = iter((viterbi(model, lines.indicators, lines.per) == CONTENT).tolist())
                for t in texts:
                    at, row = 0, []
                    for line in t.decode().split("\n"):
                        row.append({"start": at, "end": at + len(line), "content": next(content)})
                        at += len(line) + 1
                    rows.append(row)
            yield pa.array(rows, type=kind)

    return spans(text)
