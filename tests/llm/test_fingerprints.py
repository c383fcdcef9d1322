"""One-permutation fingerprints and the chosen-path join against exact Jaccard."""

import collections
import hashlib
import random

import numpy as np
import pytest
from compare import connect, difference
from conftest import FOLDER
from pyspark.sql import functions as F

from sparsile.llm import chosen_path, oph
from sparsile.llm.components import connected
from sparsile.llm.queries import CHECKS, QUERIES


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_edited_texts(spark, rows):
    keys, errors = sorted(rows), []
    found = {r.doc_id: r for r in QUERIES["op4_one_permutation"](spark, FOLDER).collect()}
    assert len(found) == len(keys)
    prints = {}
    for key, following in zip(keys, [*keys[1:], keys[0]]):
        text, after, r = rows[key], rows[following], found[key]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r.near_edited - jaccard(shingles(text), shingles(edited))), abs(r.near_next - jaccard(shingles(text), shingles(after)))]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


@pytest.mark.parametrize("n_bins,bits", [(256, 8), (512, 4), (128, 1)])
def test_estimates_are_unbiased(n_bins, bits):
    rng = np.random.default_rng(9)
    for share in (0.1, 0.5, 0.9):
        base = rng.integers(0, 2**63, 3000).astype(np.uint64)
        kept = int(3000 * 2 * share / (1 + share))
        other = np.concatenate([base[:kept], rng.integers(0, 2**63, 3000 - kept).astype(np.uint64)])
        estimates = []
        for shift in range(12):
            move = np.uint64(rng.integers(1, 2**62) * 2 + 1)
            a, b = oph.pack(np.concatenate([base * move, other * move]), np.array([3000, 3000]), n_bins, bits)
            estimates.append(oph.likeness_of([a], [b], n_bins, bits)[0])
        assert abs(np.mean(estimates) - share) < 0.06


def test_likeness_column(spark):
    texts = spark.createDataFrame([(None, ""), ("", "a b c d e f"), ("a b c", "a b c")], "x string, y string")
    got = texts.select(oph.likeness(oph.fingerprint(F.col("x")), oph.fingerprint(F.col("y"))).alias("l")).collect()
    assert [r.l for r in got] == [1.0, 0.0, 1.0]


def exact(rows):
    sets = {k: shingles(t) for k, t in rows.items()}
    inverted, links, up = collections.defaultdict(list), collections.Counter(), {k: k for k in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        for x in s:
            inverted[x].append(k)
    for k, s in sets.items():
        for other, n in collections.Counter(o for x in s for o in inverted[x] if o != k).items():
            if n >= 0.8 * (len(s) + len(sets[other]) - n):
                links[k] += 1
                a, b = top(k), top(other)
                up[max(a, b)] = min(a, b)
    return {k: (top(k), links[k]) for k in rows}


def test_join_query(spark, rows):
    found = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op10_chosen_path"](spark, FOLDER).collect()}
    assert found == exact(rows)


def test_join_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(spark, connect(folder), QUERIES["op10_chosen_path"], CHECKS["op10_chosen_path"], folder) is None


def test_large_groups_and_common_passages(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = []
    for _ in range(800):  # near copies of one text: some pairs above the threshold, some below; larger than a leaf
        own = list(base)
        for _ in range(rnd.randrange(0, 3)):
            own[rnd.randrange(150)] = word()
        texts.append(own)
    texts += [[*passage, *[word() for _ in range(rnd.randrange(40, 200))]] for _ in range(700)]
    texts += [texts[3]] * 300
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similarity_join(docs).collect()}
    expected = exact(rows)
    assert {k: c for k, (c, _) in found.items()} == {k: c for k, (c, _) in expected.items()}
    lost = sum(abs(found[k][1] - expected[k][1]) for k in rows)
    assert lost <= 0.0005 * sum(n for _, n in expected.values())
    kept = chosen_path.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, _ in expected.values()})


def test_parameters_meet_the_target():
    assert chosen_path.runs_for(0.8, 0.9999) * chosen_path.BRANCHES < chosen_path.COORDINATES - 8
    assert chosen_path.runs_for(0.8, 0.9) < chosen_path.runs_for(0.8, 0.999999)
    assert 15 < chosen_path.least_agreement(0.8) < 0.8 * chosen_path.COORDINATES


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    found = {r.u: r.root for r in connected(chain).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
