"""Token files and the piece codec: exact round trips against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from conftest import FOLDER
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparsile.llm import piece_codec, token_frames
from sparsile.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab'sdtl rem  \n\t  \x1c\x85\xa0 ÉßñK1 9.,!?▁<0x0A>😀é́\r\nlls　"


def odd_texts(n):
    rnd = random.Random(3)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 30))) for _ in range(n)] + ["", " ", "▁", "a▁ b", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n", "<|endoftext", "x\n\n  y"]


def test_token_query(spark, rows):
    tokenizer = Tokenizer.from_file(TOKENS)
    start = 0
    found = {r.doc_id: r for r in QUERIES["op2_token_frames"](spark, FOLDER).collect()}
    for key in sorted(rows):
        ids = [*tokenizer.encode(rows[key], add_special_tokens=False).ids, 2]
        assert tuple(found[key]) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_byte_pieces_equal_the_library():
    tokenizer = Tokenizer.from_file(TOKENS)
    texts = odd_texts(3000)
    encoder = token_frames.BytePieceEncoder(TOKENS)
    assert encoder.by_piece and not token_frames.BytePieceEncoder(public_tokenizers.path("word_bpe_49k.json")).by_piece
    ids, per = encoder.encode(texts)
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == expected


def test_added_tokens_keep_their_ids():
    ids, per = token_frames.BytePieceEncoder(TOKENS).encode(["a <|endoftext|> b", "", "a"])
    assert (ids.tolist(), per.tolist()) == ([64, 220, 50256, 275, 64], [4, 0, 1])


def test_rows_of_one_key_are_spread_over_files(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    manifest = token_frames.write_tokens(docs, TOKENS, partitions=8)
    assert max(r.n_docs for r in manifest.collect()) < 1500
    found = token_frames.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
    assert token_frames.read_documents(manifest, [7]).count() == 3600


def test_frames_are_independent(tmp_path):
    path = tmp_path / "x.zst"
    rng = np.random.default_rng(2)
    given = [(k if k != 3 else None, rng.integers(0, 50_000, n)) for k, n in enumerate([5, 0, 900, 3, 2000, 1, 400])]
    with open(path, "wb") as sink:
        writer = token_frames.FrameWriter(sink, 2, frame_tokens=600)
        for key, ids in given:
            writer.add(key, ids)
        writer.close()
    whole = np.concatenate([ids for _, ids in given])
    with open(path, "rb") as source:  # any zstandard reader takes the file
        assert zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read() == whole.astype("<u2").tobytes()
    file = token_frames.FrameFile.open(pa.OSFile(str(path)))
    assert [(k, i.tolist()) for k, i in file.documents()] == [(k, i.tolist()) for k, i in given]
    read = []
    file.frame = lambda n, own=file.frame: read.append(n) or own(n)
    assert [(k, len(i)) for k, i in file.documents({4})] == [(4, 2000)]
    assert len(read) == 1 < len(file.sizes)
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(data)
    damaged = token_frames.FrameFile.open(pa.OSFile(str(path)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.frame(0)
    assert len(damaged.frame(1))


def test_requested_documents(docs, rows):
    manifest = token_frames.write_tokens(docs, TOKENS)
    found = {r.doc_id: r.ids for r in token_frames.read_documents(manifest, [7, 150]).collect()}
    tokenizer = Tokenizer.from_file(TOKENS)
    assert found == {k: [*tokenizer.encode(rows[k], add_special_tokens=False).ids, 2] for k in (7, 150)}


def test_piece_query(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op9_piece_codec"](spark, FOLDER).collect():
        ids = library.encode(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_and_spans_equal_the_library():
    codec = piece_codec.PieceCodec(MODEL)
    assert codec.by_word
    texts = odd_texts(3000)
    ids, per = codec.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(per)[:-1])):
        assert own.tolist() == codec.library.encode(text)
        data = text.encode()
        starts, ends = codec.spans(data, own)
        normal, origin = codec.normalizer.normalize(data)
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data
        assert normal.decode() == (codec.library.normalize(text) if text else "") and len(origin) == len(normal) + 1


def test_encode_and_decode_columns(docs, rows):
    encoded = docs.select("doc_id", piece_codec.encode(F.col("text"), MODEL).alias("e"))
    for r in encoded.select("doc_id", "e.*", piece_codec.decode(F.col("e.ids"), MODEL).alias("t")).collect():
        data = rows[r.doc_id].encode()
        assert r.t == rows[r.doc_id] and b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data


def test_normalisation_through_a_character_map():
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = piece_codec.OffsetNormalizer(rule.serialized_model_proto())
    rnd = random.Random(4)
    for _ in range(1500):
        text = "".join(rnd.choice("ａ①㍿ﬁ é　 ​Å½ｶﾞ가abc \t한국㌔") for _ in range(rnd.randrange(0, 14)))
        expected, offsets = rule.normalize(text, with_offsets=True)
        data = text.encode()
        normal, origin = own.normalize(data)
        assert normal.decode() == expected
        # the library counts characters, we count bytes
        at = np.cumsum([0] + [len(c.encode()) for c in expected])[: len(offsets)]
        assert [len(data[: origin[i]].decode()) for i in at] == list(offsets)


def test_known_pieces_outlive_the_limit_and_the_task():
    from sparsile.llm.memo import SequenceMemo, joined
    from sparsile.llm.token_frames import encoder_of

    asked = []
    encode = lambda pieces: asked.extend(pieces) or joined([[ord(c) for c in p] for p in pieces])
    memo = SequenceMemo(encode, lambda w: w.split("-") if "-" in w else None, limit=8)
    for i in range(40):
        texts = [["the", f"w{i}", "of-the", f"x{i}-of"], [], ["the", "of"]]
        ids, per = memo.encode(texts)
        plain = [[ord(c) for w in t for c in w.replace("-", "")] for t in texts]
        assert ids.tolist() == sum(plain, []) and per.tolist() == [len(p) for p in plain]
        assert len(memo.numbers) == len(memo.starts) == len(memo.lengths) == len(memo.seen) <= 12
    assert asked.count("the") < 5
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert encoder_of(path) is encoder_of(path)
