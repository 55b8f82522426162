import random
import re
from fractions import Fraction

import numpy as np

from nightledger.llm import hyperminhash as H
from nightledger.llm.words import mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and inter >= threshold * (len(sets[i]) + len(sets[j]) - inter):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=str)


def varied(rng, n, vocabulary):
    """Texts of which some are others with a few words changed, dropped or added."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["new"], [words[k].upper()], [words[k], "more"]])
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 250))))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["é", "中文"]
    rows = [(None, None), (1, ""), (2, None), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one two"), (6, "one two"), (7, "one  two"), (None, "only null ids have this text of six words")]
    rows += [(10 + i, t) for i, t in enumerate(varied(rng, 220, vocabulary))]
    rows += [(400, "long " + " ".join(rng.choices(vocabulary, k=30_000)))]
    rows += [(401, rows[-1][1] + " and a tail"), (None, rows[60][1])]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component_id string").repartition(3)
    want = brute(rows, Fraction(17, 20))
    assert sorted((tuple(r) for r in H.digest(docs).collect()), key=str) == want
    monkeypatch.setattr(H, "TOGETHER", 0)  # band by band, in pairs of small blocks
    monkeypatch.setattr(H, "CELL", 2_000)
    assert sorted((tuple(r) for r in H.digest(docs).collect()), key=str) == want


def test_other_threshold(spark):
    rows = [r for r in fixture() if r[0] is None or r[0] < 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in H.near_duplicates(docs).collect()), key=str) == brute(rows, Fraction(4, 5))


def test_empty_table(spark):
    assert H.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def pairs(rng, n, size, similarity):
    """n pairs of sets of hashes with about that similarity, as sorted hashes and firsts of both sides."""
    sides = ([], [])
    for _ in range(n):
        all_of = mix(rng.integers(0, 2**63, size).astype(np.uint64))
        other = round(size * (1 - similarity))
        sides[0].append(np.sort(all_of[: size - other // 2]))
        sides[1].append(np.sort(np.concatenate([all_of[: size - other], all_of[size - other // 2 :]])))
    return [(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])])) for s in sides]


def test_estimates_and_bands():
    rng = np.random.default_rng(3)
    for size in (20, 300, 5000):
        for similarity in (0.0, 0.5, 0.9):
            (a, first_a), (b, first_b) = pairs(rng, 400, size, similarity)
            regs = H.registers(a, first_a), H.registers(b, first_b)
            truth = np.array([len(np.intersect1d(a[p:q], b[r:s])) / len(np.union1d(a[p:q], b[r:s])) for p, q, r, s in zip(first_a, first_a[1:], first_b, first_b[1:])])
            found, used = H.estimate(*regs, H.level_chances(np.diff(first_a)), H.level_chances(np.diff(first_b)))
            assert abs((found - truth).mean()) < 0.02 and (np.abs(found - truth) <= 6 * np.sqrt(0.25 / used)).all()
            if similarity == 0.9:
                assert (H.band_keys(regs[0]) == H.band_keys(regs[1])).any(axis=1).all()


def test_expected_collisions_are_those_of_disjoint_sets(monkeypatch):
    monkeypatch.setattr(H, "MANTISSA", 4)  # so few bits that chance shows, and enough to be nearly even within a level
    rng = np.random.default_rng(4)
    n, size = 2000, 3000
    regs = []
    for _ in range(2):
        hashes = np.sort(mix(rng.integers(0, 2**63, (n, size)).astype(np.uint64)), axis=1).ravel()
        regs.append(H.registers(hashes, np.arange(0, n * size + 1, size)))
    seen = ((regs[0] == regs[1]) & (regs[0] != 0)).sum(axis=1).mean()
    chances = H.level_chances(np.array([size]))
    assert abs(seen - H.expected_collisions(chances, chances)[0]) < 0.06 * seen
