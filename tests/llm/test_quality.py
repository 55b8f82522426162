import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from nightledger.llm.quality import classify, dictionaries, digest, features, fitting, inputs


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n=600):
    rng = random.Random(4)
    good, bad = [f"word{i}" for i in range(300)], [f"JUNK{i}!!" for i in range(300)]
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=rng.randint(5, 200))), int(bool(i % 4))) for i in range(n)]
    return rows


def test_held_out_accuracy_and_range(spark):
    rows = corpus()
    extra = [(None, "word1 word2"), (9001, None), (9002, ""), (9003, "word3 " * 50_000), (9003, "word3 " * 50_000)]
    docs = spark.createDataFrame([(i, t, "q", 0.0) for i, t, _ in rows] + [(i, t, "q", 0.0) for i, t in extra], "doc_id long, text string, quality string, difference double")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(5, 1, 0), (6, None, 0), (None, 1, 0), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    found = digest(docs, labels).collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id) for r in found)
    score = {r.doc_id: r for r in found}
    out = [(score[i], q) for i, _, q in rows if held(i)]
    assert sum(r.predicted == q for r, q in out) >= 0.97 * len(out)
    assert score[9001].score == score[9002].score


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    frame = lambda flip: spark.createDataFrame([(i, 1 - q if flip and held(i) else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    scores = [{r.doc_id: r.score for r in classify(docs, frame(flip)).collect()} for flip in (False, True)]
    assert scores[0] == scores[1]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(docs.limit(0), none).count() == 0


def sample(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, h long")


def test_dictionaries_take_whole_texts(spark):
    """A change far behind in a labelled text changes its class's dictionary, and no other."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lasting = [" ".join(word() for _ in range(6000)) for _ in range(3)]
    tail = " quite another ending " * 300
    chosen = sample(spark, [(1, 1, 10), (2, 0, 20), (3, 1, 30)])
    docs = lambda end: spark.createDataFrame([(1, lasting[0] + end), (2, lasting[1]), (3, "short"), (4, lasting[2])], "doc_id long, text string")
    a, b = (dictionaries(docs(end), chosen, 60_000) for end in ("", tail))
    assert a[0] != b[0] and a[1] == b[1]


def test_texts_beyond_the_budget_are_left_out_whole(spark):
    assert fitting([5, 3, 4, 9, 1], 10) == [0, 1, 4] and fitting([], 10) == [] and fitting([11], 10) == []
    chosen = sample(spark, [(1, 1, 10), (2, 1, 20), (3, 1, 30), (4, 0, 5)])
    docs = lambda size: spark.createDataFrame([(1, "one " * 50), (2, "x" * size), (3, "three " * 50), (4, "bad " * 50), (4, "worse " * 50), (None, "none")], "doc_id long, text string")
    assert dictionaries(docs(2000), chosen, 1000) == dictionaries(docs(5000), chosen, 1000) != dictionaries(docs(100), chosen, 1000)


def test_score_is_the_curve_of_the_two_sizes(spark):
    """Brute force: the dictionaries and every input of the curve, worked out by hand from the returned difference."""
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = {r.doc_id: r for r in classify(docs, labels).collect()}
    known = labels.where("crc32(cast(doc_id as string)) % 3 <> 1").selectExpr("doc_id", "quality", "xxhash64(doc_id, 17) AS h")
    of = features(dictionaries(docs, known.where("pmod(h ^ shiftright(h, 20), 2) = 0")))
    points, odds = [], lambda p: math.log(max(p, 1e-12) / max(1 - p, 1e-12))
    for i, text, _ in rows:
        difference, size = of(text.encode())
        n = len(text.encode())
        assert abs(found[i].difference - difference) < 1e-12
        points.append((1.0, 100 * difference, 100 * difference * math.log2(1 + n / 256), min(math.log2((size + 2) / (2 * (n + 1))), 0.0), math.log2(1 + n / 256), odds(found[i].score)))
    x = np.array(points)
    keep = np.abs(x[:, 5]) < 20  # where the odds can still be read from the score
    beta, *_ = np.linalg.lstsq(x[keep, :5], x[keep, 5], rcond=None)
    assert keep.sum() > 50 and np.abs(x[keep, :5] @ beta - x[keep, 5]).max() < 1e-3 and len(inputs(*map(F.lit, (0.0, 0, 0)))) == 5


def test_clashing_columns_with_carry_and_a_very_long_text(spark):
    rows = corpus(120)
    extra = [(9001, "word1 " * 400_000), (9002, None)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2.0, 3) for i, t in [(i, t) for i, t, _ in rows] + extra], "doc_id long, text string, rest string, quality int, score double, h int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = {r.doc_id: r for r in classify(docs, labels, carry=True).collect()}
    assert len(found) == 122 and found[9001].text == extra[0][1] and 0 <= found[9001].score <= 1 and found[9002].rest["score"] == 2.0
