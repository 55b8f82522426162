import hashlib
import random
import re

from nightledger.llm.substrings import digest, remove_repeated_windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width):
    seen, out = {}, []
    words = [(i, WORD.findall(t or "")) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
    for i, w in words:
        gone = set()
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen:
                gone.update(range(a, a + width))
            seen[key] = True
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "中文", "a b"]
    passages = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, None), (3, "  \t\n "), (4, "one"), (4, "one"), (9, " ".join(["same"] * 60))]
    for i in range(10, 80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(3)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(70, rows[-1][1]), (200, rows[20][1]), (201, " ".join(rng.choices(vocabulary, k=50_000)))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, kept_sha256 string")
    assert sorted([tuple(r) for r in digest(docs).collect()], key=str) == brute(rows, 20)


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
