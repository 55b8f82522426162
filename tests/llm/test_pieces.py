import hashlib
import os
import random
import struct

import numpy as np
import pytest
import sentencepiece

from nightledger.llm.pieces import BPE, MODEL, UNIGRAM, Codec, digest, encode, parity, parse_model, rebuild

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the model file is not here")
ODD = [" ", "  ", "   ", " " * 15, " " * 17, "\n", "\t", "a", "b", "the", "and", "▁", "é", "中", "😀", "<s>", "</s>", "<0x41>", "<unk>", "​", "Ａ", "x" * 40, "aaaa", "....", "====="]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(n)] + [" " * k for k in range(60)]


def written(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback):
    """A small fixed model, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    scores = {"▁": -3.0, "a": -4.0, "b": -4.5, "t": -4.2, "h": -4.3, "e": -4.1, "▁the": -2.0, "the": -2.5, "th": -3.1, "he": -3.2, "▁a": -2.8, "aa": -5.0, "▁▁": -6.0, "é": -7.0, "d": -5.0, "n": -5.1, "and": -3.3}
    pieces += [(p, s, 1) for p, s in scores.items()]
    body = b"".join(written(1, written(1, p.encode()) + written(2, s) + written(3, k)) for p, s, k in pieces)
    body += written(2, written(3, 1) + written(35, int(byte_fallback)))
    return body + written(3, written(1, b"identity") + written(3, 1) + written(4, 0) + written(5, 1))


def by_words(data, texts):
    flat, sizes, _, _ = Codec(data).run(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_parity(byte_fallback):
    data = unigram_model(byte_fallback)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = parse_model(data)
    assert model.kind == UNIGRAM and model.byte_fallback == byte_fallback
    texts = odd_texts(3000)
    want = own.encode(texts)
    assert [e.ids for e in rebuild(model).encode_batch_fast(texts, add_special_tokens=False)] == want
    assert by_words(data, texts) == want


@needs_model
def test_bpe_parity():
    with open(MODEL, "rb") as file:
        data = file.read()
    model = parse_model(data)
    assert model.kind == BPE and model.byte_fallback and len(model.pieces) == 32000
    own, tokenizer, texts = sentencepiece.SentencePieceProcessor(model_proto=data), rebuild(model), odd_texts(5000)
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids == own.encode(texts)
    assert by_words(data, texts) == ids
    assert Codec(data).run(texts)[2] == tokenizer.decode_batch(ids, skip_special_tokens=False) == own.decode(ids)


@needs_model
def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert parity(docs).where("not same").count() == 0
    found = digest(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(text)
    assert all(r.round_trip and r.n_ids == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in found)


@needs_model
def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, "i"), (None, "", "i"), (2, "a b " * 100_000, None), (2, "a b", "i"), (2, "a b", "i")], "doc_id long, text string, ids string")
    found = encode(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in found)[:2] == [(0, 0), (1, 0)] and len(found) == 5
    assert all(r.round_trip for r in found)
    assert encode(docs.limit(0)).count() == 0
