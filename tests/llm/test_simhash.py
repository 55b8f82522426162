import random
import re

import numpy as np
import xxhash

from nightledger.llm.simhash import digest, groups, near_duplicate_groups, viable

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    pieces = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def component(prints, radius):
    """Smallest id reachable, by brute force over (id, fingerprint)."""
    ids, best = [i for i, _ in prints], {}
    f = np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    left = set(range(len(ids)))
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            group.add(k)
            more = [j for j in np.flatnonzero(near[k]) if j in left]
            left.difference_update(more)
            todo += more
        for k in group:
            best[ids[k]] = min(ids[j] for j in group)
    return best


def test_digest_matches_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(f"Wörd{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "x " * 40_000)]
    for i in range(10, 150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        rows.append((i, rng.choice([" ", "\t"]).join(words)))
    docs = spark.createDataFrame([(i, t, 0.5, "z") for i, t in rows], "doc_id long, text string, cell double, component_id string")
    prints = [(i, fingerprint(t, 4)) for i, t in rows]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, [component(prints, 4)[i] for i, _ in prints])}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in digest(docs).collect()} == want


def test_hot_keys_lose_no_link(spark):
    rng = random.Random(2)
    centre, seen = rng.getrandbits(64), set()
    while len(seen) < 3000:
        f = centre
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64)
        seen.add(f)
    seen |= {rng.getrandbits(64) for _ in range(500)}
    prints = list(enumerate(sorted(seen)))
    rng.shuffle(prints)
    frame = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in prints], "doc_id long, f0 long")
    want = component(prints, 4)
    for segments in (5, 7):
        assert {r.doc_id: r.component_id for r in groups(frame, [4], segments).collect()} == want


def test_ring_keeps_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    for radius, segments in ((4, 7), (8, 10), (3, 5)):
        differ = np.zeros(5000, np.uint64)
        for _ in range(radius):
            differ |= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
        assert viable(differ, radius, segments).all()
        assert not viable(rng.integers(0, 2**63, 2000).astype(np.uint64), radius, segments).all()


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_groups(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "q r s t u v"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    found = sorted([(r.doc_id, r.component_id) for r in near_duplicate_groups(docs).collect()], key=str)
    assert found == [(5, 5), (5, 5), (None, 5), (None, None)]
