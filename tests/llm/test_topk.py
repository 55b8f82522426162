import math

import numpy as np
import pyarrow as pa

from nightledger.llm import topk
from nightledger.llm.topk import Page, build_tree, digest, lifted, search, top_k, whole_vectors


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored)]
    return sorted(out)


def test_digest_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE_ROWS", 150)
    monkeypatch.setattr(topk, "LEAF_ROWS", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 12))
    rows = [(i, [float(np.float32(x)) for x in rng.choice(centres) + rng.normal(0, 0.2, 12)]) for i in range(700)]
    rows += [(i, rows[7][1]) for i in range(700, 1000)]  # a large group of copies, so many ties
    rows += [(1000, None), (1001, [1.0, None] * 6), (1050, [math.nan] * 12), (1100, [math.inf] + [0.0] * 11), (None, [0.5] * 12), (1150, [0.0] * 12), (1151, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    assert sorted(map(tuple, digest(frame).collect())) == brute(rows, 5)


def test_bounds_avoid_comparisons():
    rng = np.random.default_rng(4)
    rows = (rng.normal(0, 20, (30, 16))[rng.integers(0, 30, 3000)] + rng.normal(0, 1, (3000, 16))).astype(np.int64)
    most = float((rows * rows).sum(axis=1).max())
    order, nodes, distance = build_tree(lifted(rows, most))
    assert sorted(order) == list(range(3000))
    page = Page(np.arange(3000)[order].tobytes(), rows[order].tobytes(), nodes.tobytes(), distance.tobytes(), 16, most)
    total = 0
    for i in range(0, 3000, 100):
        best, compared = search([page], i, rows[i], 5, most)
        scores = rows @ rows[i]
        assert best == sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        total += compared
    assert total < 0.7 * 30 * 3000


def test_few_rows_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in digest(frame).collect()] == [(0, 1, 1, 256 * 128)]
    rows = whole_vectors(frame.limit(0), "vec_id", "embedding")
    assert top_k(rows, rows).count() == 0


def test_an_empty_vector_is_one_of_zeros(spark):
    frame = spark.createDataFrame([(0, [-1.0, -1.0]), (1, [1.0, 1.0]), (2, []), (50, [])], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in digest(frame).collect())
    assert found == [(0, 1, 2, 0), (0, 2, 50, 0), (0, 3, 1, -2 * 256 * 256), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


def test_the_root_spares_most_of_clustered_rows(spark, monkeypatch):
    """With twenty clusters most queries are compared with a small share of the rows, counted in all tasks of both rounds, and the result is exact."""
    monkeypatch.setattr(topk, "PAGE_ROWS", 100)
    monkeypatch.setattr(topk, "LEAF_ROWS", 20)
    monkeypatch.setattr(topk, "PAGES_A_TASK", 1)
    rng = np.random.default_rng(8)
    x = (rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 4000)] + rng.normal(0, 0.02, (4000, 16))).tolist()
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    rows = whole_vectors(frame, "vec_id", "embedding")
    whole = np.floor(256 * np.array(x)).astype(np.int64)
    queries = rows.where("vec_id % 500 = 0")
    found = topk.top_k(rows, queries, 5).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    for i in range(0, 4000, 500):
        want = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in want]
    compared = {r.query_id: r.compared for r in topk.comparisons(rows, queries, 5).collect()}
    assert set(compared) == set(range(0, 4000, 500)) and 5 < np.median(list(compared.values())) < 400
    assert np.mean(list(compared.values())) < 1000  # a query whose own page has no good row is compared with all


def test_pages_go_only_where_queries_are(spark, monkeypatch):
    """Of clustered rows and many query groups few cells of the grid exist; results stay exact."""
    monkeypatch.setattr(topk, "PAGE_ROWS", 100)
    monkeypatch.setattr(topk, "LEAF_ROWS", 20)
    monkeypatch.setattr(topk, "PAGES_A_TASK", 1)
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 20)
    rng = np.random.default_rng(3)
    x = (rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 4000)] + rng.normal(0, 0.02, (4000, 16))).tolist()
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    rows = whole_vectors(frame, "vec_id", "embedding")
    queries = rows.where("vec_id % 10 = 0")
    answers = topk._answers

    def seen(*args):
        run = answers(*args)

        def counted(pages, asked):
            out = run(pages, asked)
            cell = (asked.column("q")[0].as_py(), min(pages.column("shell").to_pylist(), default=-1))
            return out.append_column("q", pa.array([cell[0]] * out.num_rows, pa.int64())).append_column("p", pa.array([cell[1]] * out.num_rows, pa.int64()))

        return counted

    monkeypatch.setattr(topk, "_answers", seen)
    monkeypatch.setattr(topk, "ANSWER", topk.ANSWER + ", q long, p long")
    found, _ = topk._searched(rows, queries, 5, topk.PIVOTS)
    cells = found.where("vec_id is null").collect()
    whole = np.floor(256 * np.array(x)).astype(np.int64)
    grid = {(r.q, r.p) for r in cells}
    groups, places = ({c[k] for c in grid} for k in (0, 1))
    assert len({r.query_id for r in cells}) == 400 and -1 not in places
    assert len(groups) >= 15 and len(places) >= 40 and len(grid) < 0.7 * len(groups) * len(places)
    monkeypatch.undo()
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 20)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(rows, queries, 5).collect()}
    for i in range(0, 4000, 10):
        want = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in want]


def test_query_groups():
    """Shells share groups; a crowded one has several."""
    n = topk.QUERIES_A_TASK
    assert topk._query_groups([(3, n // 2), (5, n // 2), (8, 3 * n), (9, 1)]) == [(3, 0, 1), (5, 0, 1), (8, 1, 3), (9, 4, 1)]
