import hashlib
import random
import re

import numpy as np

from nightledger.llm import imatch
from nightledger.llm.imatch import fingerprint_documents
from nightledger.llm.words import Words, mix


def corpus():
    rng = random.Random(8)
    words = [f"term{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(0, 400, 2)]
    rows += [(1001, None), (1003, ""), (1005, "x"), (1007, "Straße ünï 中文 texts"), (1009, rows[7][1]), (1011, " ".join(rng.choices(words, k=60_000))), (1013, "only once here")]
    return rows


def test_edited_texts_and_order(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RUN_BYTES", 20_000)  # many runs
    rows = corpus()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0, True, "s") for i, t in rows], "doc_id long, text string, run int, tail boolean, top string")
    found = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    line = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        half = len(text) // 2
        r = found[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found[14].fingerprint == found[1009].fingerprint
    assert found[1001].fingerprint == found[1003].fingerprint != found[1005].fingerprint
    long = [found[i] for i, t in rows if i < 400 and len(t) > 400]
    assert np.mean([r.near_edited for r in long]) > 5 * np.mean([r.near_next for r in long])
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_lexicon_is_the_band(spark):
    rows = [(i, f"all half{i % 2} tenth{i % 10} own{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(imatch.lexicon(docs, 0.05, 0.1)) == 10
    assert len(imatch.lexicon(docs, 0.05, 0.6)) == 12


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "a b"), (None, "d"), (None, None)], "doc_id long, text string")
    found = sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint_documents(docs).collect()], key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted([(1, 3, sha("a b")), (1, 3, sha("b ")), (None, 0, sha("")), (None, 1, sha("d"))], key=str)
    assert fingerprint_documents(docs.limit(0)).count() == 0


def plain_fingerprints(rows: list[tuple], low: float, high: float) -> dict:
    """doc_id -> (fingerprint, edited fingerprint, near_edited, near_next) by sets and whole numbers; of the operator it takes only the hash functions of a word and of a number."""
    mask = (1 << 64) - 1
    term = lambda w: int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), lower=True).hashes()[0])
    mixed = lambda x: int(mix(np.array([x & mask], np.uint64))[0])
    words = lambda text: {term(w) for w in re.findall("[^\x20\x09-\x0d]+", text)}
    line = [(i, t or "") for i, t in sorted(rows, key=lambda r: -r[0])]
    count = {}
    for _, text in line:
        for w in words(text):
            count[w] = count.get(w, 0) + 1
    n = len(line)
    band = {w for w, c in count.items() if max(2, n * low) <= c <= max(n * high, 2)}

    def folded(terms: list[int]) -> int:
        return mixed(sum(t * pow(imatch._STEP, k, 1 << 64) for k, t in enumerate(sorted(terms))) + 1) if terms else 0

    def prints(text: str) -> tuple[int, list[int]]:
        own = words(text)
        own = own & band or own
        small = []
        for g, rate in enumerate(imatch.RATES):
            cells = {t: (mixed(t ^ (0x9E3779B97F4A7C15 * (g + 1) & mask)) >> 20) % rate for t in own}
            for j in range(imatch.PER_RATE):
                h = folded([t for t in own if cells[t] == j])
                small.append(1 + (h >> 32) % 65535 if h else 0)
        return folded(list(own)), small

    def like(a, b) -> float:
        if a[0] == b[0]:
            return 1.0
        both = [(x, y) for x, y in zip(a[1], b[1]) if x or y]
        return sum(x == y for x, y in both) / max(len(both), 1)

    shown = lambda p: f"{p[0]:016x}" + "".join(f"{x:04x}" for x in p[1])
    out = {}
    for k, (i, text) in enumerate(line):
        after = line[(k + 1) % n][1]
        half = len(text) // 2
        own, edited, other = prints(text), prints(text[: len(text) - half] + after[:half]), prints(after)
        out[i] = (shown(own), shown(edited), like(own, edited), like(own, other))
    return out


def test_fingerprints_and_likeness_against_plain_sets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RUN_BYTES", 20_000)
    rng = random.Random(5)
    names = [f"T{i}" for i in range(700)] + ["É", "中文", "a-b"]
    rows = [(3 * i, " ".join(rng.choices(names, k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(1001, None), (1003, ""), (1005, "x"), (1007, rows[4][1]), (1009, rows[4][1].lower()), (1011, rows[4][1] + " t1 t2"), (1013, "alone here"), (1015, "\t \n"), (1017, "and " * 4000)]
    low, high = 0.02, 0.2
    found = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), low, high).collect()}
    want = plain_fingerprints(rows, low, high)
    assert found.keys() == want.keys()
    for i in want:
        assert found[i][:2] == want[i][:2] and np.allclose(found[i][2:], want[i][2:])
    assert found[1007][0] == found[12][0] == found[1009][0]
