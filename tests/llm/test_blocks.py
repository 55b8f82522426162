import random

import pytest

from nightledger.llm import blocks, lines, substrings
from tests.llm.test_lines import WORD


@pytest.fixture
def crowd(spark, monkeypatch):
    """(frame, rows in the order of their judgement): a third of the rows without an id, a third under one id."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    rng = random.Random(8)
    line = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 25)))
    pool = [line() for _ in range(60)]

    def text():
        own = [rng.choice(pool).split() if rng.random() < 0.6 else line().split() for _ in range(rng.randint(1, 8))]
        for words in own:
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "changed"
        return "\n".join(map(" ".join, own))

    frame = spark.createDataFrame([([None, 40, i][i % 3], text()) for i in range(240)], "doc_id long, text string")
    docs = blocks.texts(frame)
    dealt = blocks.with_block(docs, blocks.block_count(blocks.volume(docs)[1])).collect()
    return frame, sorted(dealt, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.block, r.text))


def test_no_block_holds_a_crowded_id(crowd):
    frame, rows = crowd
    size = {}
    for r in rows:
        size[r.block] = size.get(r.block, 0) + len(r.text)
    assert len(rows) == frame.count() and max(size.values()) < 4 * blocks.BLOCK_BYTES
    assert len({r.block for r in rows if r.doc_id is None}) > 2 and len({r.block for r in rows if r.doc_id == 40}) > 2


def test_lines_of_a_crowded_id(crowd):
    frame, rows = crowd
    earlier, want = [], []
    for r in rows:
        kept = []
        for line in r.text.split("\n"):
            own = frozenset(WORD.findall(line.lower()))
            if not any(5 * len(own & s) >= 4 * len(own | s) for s in earlier):
                kept.append(line)
            earlier.append(own)
        n = len(r.text.split("\n"))
        want.append((r.doc_id, n, n - len(kept), "\n".join(kept)))
    assert sorted(map(tuple, lines.dedup_lines(frame).collect()), key=str) == sorted(want, key=str)


def test_windows_of_a_crowded_id(crowd):
    frame, rows = crowd
    seen, want = set(), []
    for r in rows:
        words, gone = r.text.split(), set()
        for a in range(len(words) - 5):
            if tuple(words[a : a + 6]) in seen:
                gone.update(range(a, a + 6))
            seen.add(tuple(words[a : a + 6]))
        want.append((r.doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(map(tuple, substrings.remove_repeated_windows(frame, 6).collect()), key=str) == sorted(want, key=str)
