"""Every stage of the pipeline against a plain version, on what the stage before kept."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_fingerprints import exact
from test_scans import plain

import corpus_pipeline
from sparsile.llm import gam, pareto_mix
from sparsile.llm.text import raw
from sparsile.session import durable


FOLDER = "/root/testdata/sf0.01"  # large enough to hold secrets


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def kept(spark, docs):
    """The rows after each stage; the first entry is the input."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], FOLDER)))
    return out


def test_quality_stage(spark, kept, labels):
    docs = kept[0]
    model = gam.train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    table = docs.select("doc_id", "text").toArrow()
    scores = model.score(gam.measure(raw(table.column("text").combine_chunks())))
    expected = {k for k, s in zip(table.column("doc_id").to_pylist(), scores) if s >= 0.7}
    assert {r.doc_id for r in kept[1].collect()} == expected and len(expected) < docs.count()


def test_near_duplicate_stage(kept):
    rows = {r.doc_id: r.text for r in kept[1].collect()}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted({c for c, _ in exact(rows).values()})


def test_secret_stage(kept):
    before, after = ({r.doc_id: r for r in frame.collect()} for frame in (kept[2], kept[3]))
    assert before.keys() == after.keys()
    changed = 0
    for key, row in before.items():
        text, at, out = row.text, 0, []
        for start, _, end in plain(text):
            if start >= at:
                out += [text[at:start], "[secret]"]
            at = max(at, end)
        expected = "".join([*out, text[at:]])
        changed += expected != text
        assert after[key].text == expected and after[key].n_chars == len(expected)
    assert changed


def test_mixing_stage(kept):
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in pareto_mix.mix(kept[3]).collect()}
    assert Counter(r.doc_id for r in kept[4].collect()) == Counter({k: n for k, n in taken.items() if n})
    words = Counter()
    for r in kept[4].collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    targets = {r.source: r.target for r in pareto_mix.source_targets(kept[3].select("source", pareto_mix.word_count(F.col("text")).alias("size"))).collect()}
    largest = max(len(r.text.split()) for r in kept[3].collect())
    assert all(abs(words[s] - t) <= largest for s, t in targets.items())


def test_encoding_stage(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter((r.doc_id, sha(",".join(map(str, library.encode(r.text)))), sha(library.decode(library.encode(r.text)))) for r in kept[4].collect())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in kept[5].collect()) == expected


def test_stages_keep_the_columns(kept):
    assert all(frame.columns == kept[0].columns for frame in kept[:-1])


def test_run(spark, kept):
    rows = lambda frame: Counter(tuple(r) for r in frame.collect())
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(kept[-1])


def test_empty_input(spark, docs):
    frame = docs.filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        frame = durable(stage(spark, frame, FOLDER))
        assert frame.count() == 0
