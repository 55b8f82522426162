import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from nightledger.llm import nearcopies, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def survivors(rows):
    """Smallest ids of the groups, by brute force over all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if root(i) != root(j) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and similar(a, b):
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return set(least.values())


def edited(words, kind, share, draw):
    n = len(words)
    k = max(1, round(share * n))
    if kind == "appended":
        return words + draw(k)
    if kind == "cut":
        return words[:-k]
    at = n // 3
    if kind == "inserted":
        return words[:at] + draw(k) + words[at:]
    if kind == "replaced":
        return words[:at] + draw(k) + words[at + k :]
    return [draw(1)[0] if i % max(6, round(5 / share)) == 0 else w for i, w in enumerate(words)]


def corpus(seed):
    rng = np.random.default_rng(seed)
    draw = lambda k: [f"w{x % 20_000}" for x in rng.zipf(1.3, k)]
    rows, shares = [], {"appended": (0.2, 0.3), "cut": (0.17, 0.24), "inserted": (0.2, 0.3), "replaced": (0.09, 0.14), "scattered": (0.08, 0.14)}
    for i, n in enumerate([60, 200, 800] * 20):
        base = draw(n)
        rows.append((1000 * i, " ".join(base)))
        for j, (kind, (near, far)) in enumerate(shares.items()):
            rows += [(1000 * i + 2 * j + k + 1, " ".join(edited(base, kind, s, draw))) for k, s in enumerate((near, far))]
    rows += [(90_001, "One two"), (90_002, "one  TWO"), (90_003, "two one"), (90_004, ""), (90_005, " \n")]
    random.Random(seed).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_block_edits_are_found_and_less_similar_texts_stay(spark):
    rows = corpus(3)
    found = {r.doc_id for r in pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert found == survivors(rows) and len(found) < len(rows) - 300


def test_large_groups_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "TOGETHER", 500)
    monkeypatch.setattr(nearcopies, "CELL", 700)
    rows = corpus(4)
    found = {r.doc_id for r in pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert found == survivors(rows)


def test_simhash_groups_are_candidates_and_verified(spark):
    body = "a b c d e " * 300
    rows = [(i, body + " ".join(f"w{i}x{k}" for k in range(40))) for i in (1, 2)] + [(3, " ".join(f"v{k}" for k in range(340)))]
    printed = simhash.fingerprints(frame(spark, rows), [(4, False)]).withColumnRenamed("doc_id", "node")
    assert {(r.node, r.sim) for r in nearcopies.print_groups(printed).collect()} == {(1, 1), (2, 1)}
    assert not similar(*(shingles(t) for _, t in rows[:2]))  # so the whole sets tell them apart
    assert {r.doc_id for r in pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()} == {1, 2, 3}
    sets = [np.arange(0, 50, dtype=np.uint64), np.arange(5, 55, dtype=np.uint64)]  # 45 of 55 are common
    sets = [np.sort(x * np.uint64(0x9E3779B97F4A7C15)) for x in sets]
    cell = lambda sims: pa.RecordBatch.from_pydict({"cell": [7, 7], "node": [1, 2], "shingles": [x.tobytes() for x in sets], "sim": sims})
    assert sum(b.num_rows for b in nearcopies._verified(pipeline.SIMILAR)(iter([cell([1, 1])]))) == 1
