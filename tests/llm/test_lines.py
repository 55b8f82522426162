import random
import re

from nightledger.llm.lines import dedup_lines

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    earlier, out = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        kept, removed = [], 0
        for line in (text or "").split("\n"):
            own = frozenset(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
            if own and any(5 * len(own & s) >= 4 * len(own | s) for s in earlier):
                removed += 1
            else:
                kept.append(line)
            if own:
                earlier.append(own)
        out.append((i, len((text or "").split("\n")), removed, "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(900)] + ["É", "Ü"]
    base = [rng.sample(words, rng.randint(1, 40)) for _ in range(60)]

    def line():
        own = list(rng.choice(base)) if rng.random() < 0.6 else rng.sample(words, rng.randint(0, 30))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 7])):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        rng.shuffle(own)
        return rng.choice([" ", "  ", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in own)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, " "), (5, rows[3][1]), (5, rows[3][1]), (None, rows[9][1]), (300, "Only\nonly\n" + "x " * 30_000 + "\n" + "x")]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 3, "c") for i, t in rows], "doc_id long, text string, block int, part string")
        assert sorted(map(tuple, dedup_lines(docs).collect()), key=str) == brute(rows)


def test_common_words_are_dealt_out(spark):
    rows = corpus(3)
    assert sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), cell=3).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
