"""Every operator on an awkward table and on an empty one: no crash, one row per document, defined values."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparsile.llm import chosen_path, gam, line_crf, oph, pareto_mix, phrase_parse, piece_codec, rendezvous, simhash_trie, suffix_tree, token_frames, trigram_scan

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def operators(docs, labels):
    chain, additive = line_crf.train(docs, labels), gam.train(docs, labels)
    return {
        "line_crf": lambda d: d.select("doc_id", "text", line_crf.label_lines(F.col("text"), chain).alias("v")),
        "line_spans": lambda d: d.select("doc_id", "text", line_crf.line_spans(F.col("text"), chain).alias("v")),
        "token_frames": lambda d: token_frames.read_tokens(token_frames.write_tokens(d, TOKENS)),
        "gam": lambda d: d.select("doc_id", "text", gam.score(F.col("text"), additive).alias("v")),
        "oph": oph.compare_with_edits,
        "rendezvous": rendezvous.place,
        "pareto_mix": pareto_mix.mix,
        "trigram_scan": lambda d: d.select("doc_id", "text", trigram_scan.find_secrets(F.col("text")).alias("v")),
        "suffix_tree": lambda d: suffix_tree.train_and_score(d, F.lit(True)),
        "piece_codec": lambda d: d.select("doc_id", "text", piece_codec.round_trip(F.col("text"), MODEL).alias("v")),
        "chosen_path": chosen_path.similarity_join,
        "simhash_trie": simhash_trie.classes,
    }


NAMES = ["line_crf", "line_spans", "token_frames", "gam", "oph", "rendezvous", "pareto_mix", "trigram_scan", "suffix_tree", "piece_codec", "chosen_path", "simhash_trie"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(operators, edges, name):
    found = operators[name](edges).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in edges.collect())
    groups = {}
    for r in found:  # rows equal in key and text have equal results
        if name not in ("token_frames", "oph", "rendezvous") and r.doc_id in (5, 6):
            groups.setdefault(r.doc_id, set()).add(str(r))
    assert all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, empty, name):
    assert operators[name](empty).collect() == []


def test_training_without_labels(empty, labels):
    assert gam.train(empty, labels).tables == []
    assert not line_crf.train(empty, labels).weights.any()


def test_filters_keep_all_columns(edges, empty):
    for table in (edges, empty):
        for operator in (chosen_path.one_of_each, pareto_mix.mixed_documents):
            assert operator(table).columns == table.columns
    kept = chosen_path.one_of_each(edges).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "8"]
    assert {r.doc_id for r in pareto_mix.mixed_documents(edges).collect()} <= {4, 5, 6, 7, 8, None}


def test_values_of_blank_texts(operators, edges):
    scores = {r.doc_id: r.v for r in operators["gam"](edges).collect()}
    assert scores[1] == scores[2] == scores[3] == 0.0
    mix = {r.doc_id: r for r in operators["pareto_mix"](edges).collect() if r.doc_id in (1, 2, 3)}
    assert all(r.size == r.taken == 0 for r in mix.values())
    classes = {r.doc_id: (r.class_id, r.n_links) for r in operators["chosen_path"](edges).collect()}
    assert classes[1] == classes[2] == classes[3] == (1, 3)
    assert classes[6] == classes[7] == classes[None] != classes[4]


def test_phrases_of_awkward_rows(edges, empty):
    assert phrase_parse.mine(empty).collect() == []
    found = {(r.lang, r.phrase): r for r in phrase_parse.mine(edges, least=3).collect()}
    # "a b … l" stands in four rows and repeats count; every part of it goes with the longest ones
    assert {p for lang, p in found if p.startswith("a ")} == {"a b c d e"}
    assert found["und", "a b c d e"].a == 4


def test_simhash_of_awkward_rows(operators, edges):
    found = {r.doc_id: r for r in operators["simhash_trie"](edges).collect()}
    assert found[1].fingerprint == found[2].fingerprint == found[3].fingerprint == "0" * 16
    assert {found[k].component_id for k in (1, 2, 3)} == {1} and {found[k].component_id for k in (6, 7)} == {6}
