import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from nightledger.llm.runs import digest, find_runs, periodic_runs
from nightledger.llm.words import mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """(start, length, period) of every run by trying all periods."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def edited(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = edited(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def hashed(words):
    return mix(np.array([hash(w) & 0xFFFFFFFFFFFFFFFF for w in words], np.uint64))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_strings(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 30])
        words = []
        while len(words) < rng.randint(1, 400):
            unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64]))]
            if rng.random() < 0.4:  # a unit that is periodic itself
                unit = unit[:3] * rng.randint(1, 12) + unit[:1]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 300)]
        start, end, period = find_runs(hashed(words), len(words))
        got = sorted((s, e - s, q) for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()) if e - s >= 6)
        assert got == brute(words)


def test_fibonacci_and_doubling_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    doubled = "a"
    while len(doubled) < 1024:
        doubled += doubled.translate(str.maketrans("ab", "ba"))
    for text in (b, doubled, b * 5, doubled * 4, "ab" * 700, "a" * 999, "aab" * 50 + "ab" * 60):
        start, end, period = find_runs(hashed(list(text)), len(text))
        assert sorted((s, e - s, q) for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()) if e - s >= 6) == brute(list(text))


def test_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(None, None), (None, "b " * 9), (1, ""), (2, None), (3, " \t\n"), (4, "one"), (4, "one"), (5, "x " * 30), (6, "a b c " * 12), (7, "é 中 " * 8 + "end")]
    for i in range(10, 120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = " ".join(rng.choices(["a", "b", "cc", "é"], k=rng.randint(1, 20)))
            parts.append(rng.choice([" ", "\n", "\t "]).join([unit] * rng.choice([1, 1, 2, 4, 6])))
        rows.append((i, " ".join(parts)))
    rows += [(rows[-1][0], rows[-1][1]), (300, " ".join(rng.choices(["p", "q", "r"], k=3000))), (301, "long line of words " * 2000 + "tail " * 5)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed int").repartition(3)
    got = sorted((tuple(r) for r in digest(docs).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_real_outputs_and_empty_table(spark):
    found = periodic_runs(spark.createDataFrame([(9, "so " * 6 + "it goes")], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 6, 1)] and found["collapsed"] == "so it goes" and found["n_words"] == 8
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
