import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from nightledger.llm.mixing import Code, Mixer, log2_likelihood, packed, slots
from nightledger.llm.scoring import TokenModel, Tokens, score
from nightledger.llm.words import Words, texts_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def test_base_counts_and_properties(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)] + ["É", "Zed", "été"]
    halves, ranks = (words[::2], words[1:600:2]), [1 / (k + 1) for k in range(400)]  # as if of two languages: a text keeps to one of them
    rows = [(i, " ".join(rng.choices(halves[i % 2], ranks[: len(halves[i % 2])], k=rng.randint(0, 120)))) for i in range(1200)]
    rows += [(2300, None), (2301, ""), (2302, " \t"), (2303, "the same text"), (2304, "the same text"), (2305, "lone" * 20_000), (2306, " ".join(rng.choices(words, k=20_000))), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, block int, score double")
    found = {r.doc_id: r for r in score(docs, table_bits=18).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert math.isclose(found[2303].score, found[2304].score, rel_tol=1e-6)
    out = [r for r in found.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > sum(r.base_score for r in out), (sum(r.score for r in out), sum(r.base_score for r in out))


def test_a_tree_predicts_a_distribution():
    rng = np.random.default_rng(1)
    code = Code.of(rng.integers(0, 50, 37))
    mixer = Mixer(2)
    tables = [packed(rng.integers(0, 900, 2 * len(code.depth))), packed(rng.integers(0, 9, 2 << 8))]
    mixer.weights += rng.normal(0, 0.2, mixer.weights.shape).astype(np.float32)
    symbols = np.arange(37)
    length, node, bit, where = slots(code, symbols, [np.full(37, 99, np.uint32)], 8)
    x, gate = Mixer.inputs(tables, where, code.depth[node] * 0)
    odds, _, _ = mixer.refined(mixer.mixed(x, gate), code.depth[node])
    bits = np.add.reduceat(log2_likelihood(odds, bit).astype(float), np.cumsum(length) - length)
    assert math.isclose(np.exp2(bits).sum(), 1, rel_tol=1e-4)


def test_learning_lowers_the_cost():
    rng = np.random.default_rng(2)
    code = Code.of(np.array([8, 4, 2, 1]))
    symbols = rng.choice(4, 4000, p=[0.1, 0.1, 0.1, 0.7])
    _, node, bit, where = slots(code, symbols, [], 8)
    counts = np.zeros(2 * len(code.depth), np.int64)
    np.add.at(counts, node.astype(np.int64) * 2 + bit, 1)
    mixer, depth = Mixer(1), code.depth[node]
    mixer.weights[:] = 0.1
    x, gate = Mixer.inputs([packed(counts)], where, depth)
    cost = lambda: -log2_likelihood(mixer.refined(mixer.mixed(x, gate), depth)[0], bit).sum()
    before = cost()
    for _ in range(50):
        mixer.learn(x, gate, depth, bit.astype(np.float32))
    assert cost() < before


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string"), table_bits=10).count() == 0


def test_scores_follow_from_brute_force_counts(spark):
    """The exchanged counts of tokens and pairs give the scores that counts made by hand give."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(150)] + ["É", "Zed"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)] + [(900, "never seen by others"), (901, ""), (902, rows_text := "v1 v2 v3"), (903, rows_text)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    single, pair = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            own = tokens(text)
            single.update(own)
            pair.update(zip(["<s>", *own], own))
    rows.sort()
    data, offsets = texts_of(pa.array([t for _, t in rows]))
    stream = Tokens(Words(data, offsets, lower=True))
    flat = [(a, b) for _, text in rows for a, b in zip(["<s>", *tokens(text)], tokens(text))]
    learning = np.repeat([not held[i] for i, _ in rows], stream.size)
    model = TokenModel(stream, np.array([single[b] for _, b in flat]), np.array([pair[x] for x in flat]), sum(single.values()), single[None], 12)
    model.learn(learning)
    want = np.add.reduceat(np.log10(model.probability()), stream.first[:-1])
    found = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), table_bits=12).collect()}
    for (i, text), w in zip(rows, want):
        assert math.isclose(found[i].score, w, rel_tol=1e-9)
    assert found[900].n_known < found[900].n_tokens


def test_token_probabilities_sum_to_one():
    """Whatever the two bits' probabilities are, all tokens that can follow, and the unknown, share a probability of one."""
    follows, single = {"x": 3, "y": 1}, {"x": 5, "y": 4, "z": 2, None: 3}
    for a, b in ((0.3, 0.8), (1.0, 0.1), (0.0, 0.9)):
        known = [a * follows.get(w, 0) / 4 + (1 - a) * b * single[w] / 14 for w in single]
        assert math.isclose(sum(known) + (1 - a) * (1 - b), 1)
