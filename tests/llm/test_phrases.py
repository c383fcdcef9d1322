"""Phrase collocations: parse, counts and scores."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from conftest import FOLDER

from sparsile.llm import phrase_parse
from sparsile.llm.queries import CHECKS, QUERIES


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)) if w]


def plain(rows, least, top, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i : i + k]] = max(inside[lang, words[i : i + k]], a)
    out = []
    for lang in n:
        scored = []
        for (other, words), a in found.items():
            if other == lang and 100 * inside[lang, words] < 100 * a:
                cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_equals_sql(spark, folder):
    assert difference(spark, connect(folder), QUERIES["op11_phrase_parse"], CHECKS["op11_phrase_parse"], folder) is None


@pytest.mark.parametrize("trigger", [1, 3, 1 << 40])
def test_equals_plain_counts(spark, trigger):
    rng = random.Random(trigger)
    words = ["Ab", "ab", "c", "É", "é", "日本", "x y", "d"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", " ", ". ", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "a " * 500), ("en", None), ("fr", " ;;. ")]
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    got = phrase_parse.mine(docs, least=12, top=50, trigger=trigger)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 12, 50)


def test_long_texts_are_cut_between_pieces():
    text = "A b.C d\n\ne;  ,F g h" * 50
    for size in (1, 13, 1000):
        assert [[w.decode() for w in p] for part in phrase_parse.pieces_of(text.encode(), size) for p in part] == pieces(text)


def test_shared_passages_meet_in_the_dictionary(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(400))
    docs = spark.createDataFrame([(" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(30))]), "en") for _ in range(50)], "text string, lang string")
    chunks = phrase_parse.dictionary(docs).collect()
    assert sum(r.n == 50 for r in chunks) > 10  # the inside of the passage is parsed alike everywhere
    assert sum(len(r.chunk) for r in chunks) < 0.5 * sum(r.n * len(r.chunk) for r in chunks)


def test_full_mark_table_changes_nothing(spark, monkeypatch, docs):
    want = [tuple(r) for r in phrase_parse.mine(docs, least=30).collect()]
    monkeypatch.setattr(phrase_parse, "_mark_table", lambda grams, width: np.full(8, 255, np.uint8))
    assert sorted(tuple(r) for r in phrase_parse.mine(docs, least=30).collect()) == sorted(want)
