import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nightledger.llm import alignment
from nightledger.llm.alignment import BYTE_BPE, PLAIN_BYTES, PairIndex, align, groups, pack, unpack
from nightledger.llm.pieces import MODEL

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    names = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in PLAIN_BYTES)}
    a_bytes = {i: bytes(names[c] for c in t) for t, i in json.load(open(BYTE_BPE))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return lambda t: (a.encode(" " + t, add_special_tokens=False).ids, a_bytes), lambda t: (b.encode(t), b_bytes)


def spans(ids, pieces):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(pieces[i])))
        at += len(pieces[i])
    return out


def brute(rows, libraries):
    """Each row by the libraries themselves and pair by pair."""
    done = []
    for doc_id, text in rows:
        a, pa, b, pb = (), {}, (), {}
        if text:
            (a, pa), (b, pb) = libraries[0](text), libraries[1](text)
            whole = (" " + text).encode()
            if b"".join(pa[i] for i in a) != whole or b"".join(pb[i] for i in b) != whole:
                a, b = (), ()
        sa, sb = spans(a, pa), spans(b, pb)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        links, start = [], 0
        for i, (s, e) in zip(a, sa):
            for k in range(start, len(b)):
                if sb[k][0] >= e:
                    break
                if sb[k][1] > s:
                    links.append((i, b[k]))
                else:
                    start = k
        parts, x, y = [], 0, 0
        for cut in cuts:
            u, v = x, y
            while u < len(a) and sa[u][1] <= cut:
                u += 1
            while v < len(b) and sb[v][1] <= cut:
                v += 1
            parts.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        done.append((doc_id, len(a), len(b), len(cuts), links, ";".join(parts)))
    count = Counter(p for *_, links, _ in done for p in set(links))
    best: dict[int, int] = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    times = Counter(p for *_, links, _ in done for p in links)
    table = [(d, na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for d, na, nb, ng, links, text in done]
    return sorted(table, key=str), {p: (n, times[p]) for p, n in count.items()}, {d: text for d, *_, text in done}


def fixture():
    rng = random.Random(2)
    words = ["the", "Then", "naïve", "中文字", "\U0001f600", "x1y2", "don't", "<|endoftext|>", "</s>", "<0x41>", "ሴꯍ", "   ", "\n\n", "\t", "a" * 40, "12345", "é", "é", "\x00", " ", "ﬀ", "ÿ"]
    rows = [(None, None), (None, "the the"), (1, ""), (2, None), (3, " "), (4, "one"), (4, "one"), (5, "a ▁ mark"), (6, "▁"), (7, "\n"), (8, "  two  spaces "), (9, "the " * 3000)]
    rows += [(10 + i, rng.choice([" ", "", "  "]).join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(120)]
    rows += [(300, " ".join(rng.choices(words, k=5000))), (301, " " * 5000 + "x"), (302, "z" * 5000)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, libraries, monkeypatch, small):
    if small:  # many segments and key partitions
        monkeypatch.setattr(alignment, "KEYS_A_PARTITION", 100)
    rows = fixture()
    table, pairs, texts = brute(rows, libraries)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, seg int, keys string").repartition(7 if small else 2)
    found = align(docs)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == table
    if small:
        assert {(r.a, r.b): (r.n_documents, r.n_links) for r in PairIndex(docs).pair_counts().collect()} == pairs
        assert {r.doc_id: r.groups for r in groups(docs).collect() if r.doc_id} == {d: t for d, t in texts.items() if d}


def test_segments_of_many_documents(spark, libraries):
    rows = [(i, f"{i % 7} a") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = align(docs).agg({"n_links": "sum", "count_sum": "sum"}).first()
    one = brute(rows[:7], libraries)[0]
    assert found["sum(n_links)"] == sum(len(rows[k::7]) * r[4] for k, r in enumerate(sorted(one)))
    assert PairIndex(docs).segments.count() == 3


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for docs in (1, 5, 300, 16_383):
        full = rng.random((60, docs)) < rng.choice([0.0, 0.001, 0.05, 0.5, 1.0], 60)[:, None]
        row, doc = np.nonzero(full)
        counts, gaps, bits = pack(row, doc, 60, docs)
        back = np.zeros_like(full)
        back[unpack(counts, gaps, bits, docs)] = True
        assert (back == full).all() and (counts == full.sum(axis=1)).all()


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_ids_are_the_libraries_on_the_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, _, texts = brute([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert {r.doc_id: r.groups for r in groups(docs).collect()} == texts
