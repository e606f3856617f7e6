"""SentencePiece and token shards against the libraries they must agree with."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from tokenizers import Tokenizer

from leontia.llm import sentencepiece, tokenfile

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
TEXTS = ["", None, " ", "  a  b", "Hello world.\nNext\tline  ", "ñandú éè 漢字 😀 \x00 ▁x", "a" * 300, "Zürich " * 400, "été́ é", "<|endoftext|> x", "ab<|startoftext|>cd", "don't I'LL 123 4.5", "x y z"]
TEXTS += ["".join(rng.choice("abc dé \n.ñ漢") for _ in range(rng.randrange(120))) for _ in range(60)] + ["same words here"] * 3


def test_sentencepiece_equals_library(docs):
    lib = library.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r for r in sentencepiece.encode_documents(docs(TEXTS, extra=True), PIECES).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == lib.encode(t or ""), t
        assert rows[i].decoded == (t or "").replace("▁", " ")
    digests = {r.doc_id: r for r in sentencepiece.token_digests(docs(TEXTS), PIECES).collect()}
    for i, r in rows.items():
        assert digests[i].n_tokens == len(r.ids) and digests[i].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert digests[i].round_trip == ("▁" not in (TEXTS[i] or ""))


def _proto(pieces, kind):
    def field(n, body):
        return bytes([n << 3 | 2, *([len(body)] if len(body) < 128 else [len(body) & 127 | 128, len(body) >> 7])]) + body

    import struct

    out = b""
    for piece, score, t in pieces:
        out += field(1, field(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, t]))
    return out + field(2, bytes([3 << 3, kind])) + field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


@pytest.mark.parametrize("kind", [1, 2])
def test_small_models_equal_library(kind):
    r = random.Random(kind)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    strings = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(40)} | {"▁" + "".join(r.choice("abc") for _ in range(r.randrange(0, 4))) for _ in range(15)})
    pieces += [(s, -float(i) - 0.37 * r.random(), 1) for i, s in enumerate(r.sample(strings, len(strings)))]
    raw = _proto(pieces, kind)
    lib = library.SentencePieceProcessor(model_proto=raw)
    model = sentencepiece.Model(raw)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randrange(0, 90))) for _ in range(200)] + ["abc" * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat, counts = model.encode(sentencepiece.WordCache(model.encode_words, np.int32), data, off)
    got = np.split(flat, np.cumsum(counts)[:-1])
    for t, g in zip(texts, got):
        assert g.tolist() == lib.encode(t), t


def test_token_output_equals_library(docs):
    lib = Tokenizer.from_file(WORDS)
    rows = sorted(tokenfile.token_output(docs(TEXTS, extra=True), WORDS).collect())
    start = 0
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_elias_fano(n):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, 50 * n + 1, n))
    raw = tokenfile.ef_encode(values)
    ef = tokenfile.EliasFano(memoryview(raw))
    assert ef.size == len(raw) and ef.select(np.arange(n)).tolist() == values.tolist()
    for lo in range(0, n, 37):
        at = np.arange(lo, min(n, lo + 100))
        assert ef.select(at).tolist() == values[at].tolist() and ef.select(at[::7]).tolist() == values[at[::7]].tolist()
    assert n < 1000 or len(raw) < 2 * n


def test_shard_random_access():
    counts, ids = np.array([1, 5, 1, 700]), np.arange(707, dtype=np.uint16)
    shard = tokenfile.Shard(tokenfile.pack(np.array([3, 3, 9, 1 << 40]), counts, ids))
    assert shard.document(1).tolist() == [1, 2, 3, 4, 5] and len(shard.document(3)) == 700 and shard.document(0).tolist() == [0]
    assert shard.names(0, 4).to_pylist() == [3, 3, 9, 1 << 40] and shard.bounds(1, 3).tolist() == [1, 6, 7]
    wide = np.array([-(1 << 63), -5, (1 << 63) - 1])
    shard = tokenfile.Shard(tokenfile.pack(wide, np.array([1, 1, 1]), ids[:3]))
    assert shard.names(0, 3).to_pylist() == wide.tolist()


def test_ids_that_are_null_or_repeated(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "READ", 2)
    rows = [(None, "x y z"), (3, "a b"), (None, "q"), (-7, ""), (3, "a b"), ((1 << 62) + 1, "one two"), (None, None), (3, "c")]
    out = sorted(tokenfile.token_output(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, None, None, -7, 3, 3, 3, (1 << 62) + 1]
    ends = [r.start + r.n_tokens for r in out]
    assert [r.start for r in out] == [0, *ends[:-1]]
    lib = Tokenizer.from_file(WORDS)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in out) == want


def test_texts_that_collide_by_polynomials(docs):
    """Complementary words of Thue and Morse, whose polynomial hashes modulo 2^64 are equal, are told apart."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]
    texts += [" ".join(texts), "\n".join([*texts, texts[0]])]
    tokens, pieces = Tokenizer.from_file(WORDS), library.SentencePieceProcessor(model_file=PIECES)
    for r in tokenfile.token_output(docs(texts), WORDS).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(tokens.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4").tobytes())
    for r in sentencepiece.encode_documents(docs(texts), PIECES).collect():
        assert r.ids == pieces.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]


def test_empty_tables(docs):
    none = docs([])
    assert tokenfile.token_output(none, WORDS).count() == 0
    assert sentencepiece.token_digests(none, PIECES).count() == 0
