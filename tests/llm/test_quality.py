"""Line labels and the additive model."""

import itertools
import zlib

import numpy as np
from conftest import FOLDER
from pyspark.sql import functions as F

from sparsile.llm import gam, line_crf
from sparsile.llm.labels import labelled_sample
from sparsile.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


def test_measures_against_plain_loops(spark, rows):
    found = {r.doc_id: r for r in QUERIES["op1_line_crf"](spark, FOLDER).collect()}
    assert len(found) == len(rows)
    for key, text in rows.items():
        words = words_of(text)
        seen, covered = {}, set()
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i : i + 5]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + k for p in places for k in range(5)}
        earlier, copies = set(), 0
        for line in text.split("\n"):
            copies += bool(words_of(line)) and line in earlier
            earlier.add(line)
        r = found[key]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), copies)
        assert (r.word_chars, r.n_symbols) == (sum(c not in BLANKS for c in text), sum(c in "#*$%&|<>" for c in text))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_viterbi_and_expectations_against_all_labellings():
    rng = np.random.default_rng(5)
    model = line_crf.ChainModel(rng.normal(size=line_crf.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    starts = np.cumsum([0] + [len(c) + 1 for c in line_crf.CUTS.values()])[:-1]
    sizes = [len(c) + 1 for c in line_crf.CUTS.values()]
    per = np.array([1, 6, 3, 6])
    indicators = np.stack([starts[j] + rng.integers(0, sizes[j], per.sum()) for j in range(len(sizes))], 1)
    votes = model.votes(indicators)
    labels = line_crf.viterbi(model, indicators, per)
    p, moves, _ = line_crf._expectations(model, votes, per)
    expected_moves, at = np.zeros((2, 2)), 0
    for n in per:
        own = votes[at : at + n]
        score = lambda y: model.first[y[0]] + own[range(n), y].sum() + sum(model.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = [list(y) for y in itertools.product((0, 1), repeat=int(n))]
        weights = np.exp([score(y) for y in every])
        assert labels[at : at + n].tolist() == every[int(weights.argmax())]
        np.testing.assert_allclose(p[at : at + n], weights @ np.array(every) / weights.sum())
        for y, w in zip(every, weights / weights.sum()):
            for a, b in zip(y, y[1:]):
                expected_moves[a, b] += w
        at += n
    np.testing.assert_allclose(moves, expected_moves)


def test_labels_are_learned(spark, rows, labels):
    kept = {r.doc_id: r for r in QUERIES["op1_line_crf"](spark, FOLDER).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    good = [kept[k].kept for k, q in marks.items() if q == 1 and not kept[k].base_failed]
    bad = [kept[k].kept for k, q in marks.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_line_spans_tile_the_text(docs, labels, rows):
    model = line_crf.train(docs, labels)
    for r in docs.select("doc_id", line_crf.line_spans(F.col("text"), model).alias("s")).collect():
        assert "\n".join(rows[r.doc_id][s.start : s.end] for s in r.s) == rows[r.doc_id]


def test_held_out_scores(spark, labels):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op3_additive_quality"](spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [(found[k].score, q) for k, q in marks.items() if k in found and found[k].held_out]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > 0.97 and all(0 <= s <= 1 for s, _ in out)


def test_scores_are_table_sums_and_pairs_help():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pure interaction
    alone, paired = gam.fit(x, y, pairs=0), gam.fit(x, y)
    assert np.mean((alone.score(x) > 0.5) == y) < 0.65 < 0.9 < np.mean((paired.score(x) > 0.5) == y)
    row = x[:1]
    by_hand = paired.base + sum(t[np.searchsorted(c, row[0, j], side="right")] for j, (c, t) in enumerate(zip(paired.cuts, paired.tables)))
    by_hand += sum(t[np.searchsorted(paired.coarse[a], row[0, a], side="right"), np.searchsorted(paired.coarse[b], row[0, b], side="right")] for a, b, t in paired.pairs)
    np.testing.assert_allclose(paired.logit(row)[0], by_hand)


def test_sample_has_one_text_per_label(spark):
    docs = spark.createDataFrame([*((1, f"copy {i % 7}") for i in range(300)), (2, "two"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (2, 1)], "doc_id long, quality int")
    sample = labelled_sample(docs, marks, "text", "quality", "doc_id", 10).to_pylist()
    assert sorted((r["text"].split()[0], r["label"]) for r in sample) == [("copy", 1), ("two", 0), ("two", 1)]
