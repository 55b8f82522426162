"""Exact top-k inner products by best-first search in M-trees.

Inner products become a metric by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest rows have the largest inner products. The root has a pivot for each page of
rows, at most ``PIVOTS``; a pivot's rows are cut into shells by their distance to it, and shells are pages of bounded size. Each page is an M-tree
whose nodes store a routing row, a covering radius and the distance to the parent's routing row.
A query first searches the page at its own place, which gives it a k-th score; then it is sent only to shells whose distances, by the triangle inequality, leave room for
that score, and goes through the nodes of their pages in the order of their upper bounds. Stored distances rule out entries before any distance to them is computed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

PAGE_ROWS = 4096
LEAF_ROWS = 128
FANOUT = 32
PIVOTS = 4096  # rows at most that pages are gathered around, those of the smallest hashes
SHELLS = 64  # of a pivot at most
PAGES_A_TASK = 4
QUERIES_A_TASK = 2048
ANSWER = "query_id long, vec_id long, score long, compared long"
FIRST = "vec_id long, vector array<long>, q int, least long, compared long"
_NODE = np.dtype([("row", "<i8"), ("radius", "<f8"), ("parent", "<f8"), ("first", "<i8"), ("count", "<i8"), ("leaf", "?")])


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and vector (floor(scale * x) of each component x as double). Rows with a null id, a null vector, or
    a null or non-finite component are left out; an empty vector is one of zeros."""
    fine = F.forall(F.col("v"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("vector"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lifted(rows: np.ndarray, most: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def build_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, nodes, distance of each ordered row to its leaf's routing row)."""
    far = lambda rows, centre: np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
    nodes = [[0, 0.0, 0.0, 0, 0, True]]
    todo = [(0, np.arange(len(x)))]
    order, distance, placed = [], [], 0
    while todo:
        node, rows = todo.pop(0)
        centre = nodes[node][0]
        d = far(rows, centre)
        nodes[node][1] = float(d.max())
        if len(rows) <= LEAF_ROWS:
            nodes[node][3:] = [placed, len(rows), True]
            order.append(rows)
            distance.append(d)
            placed += len(rows)
            continue
        groups = min(FANOUT, -(-len(rows) // LEAF_ROWS))
        seeds = rows[np.linspace(0, len(rows) - 1, groups).astype(np.int64)]
        near = np.argmin((x[seeds] ** 2).sum(axis=1)[None, :] - 2 * x[rows] @ x[seeds].T, axis=1)
        if np.bincount(near, minlength=groups).max() == len(rows):  # rows too alike to tell apart
            near = np.arange(len(rows)) % groups
        nodes[node][3:] = [len(nodes), 0, False]
        for g in range(groups):
            own = rows[near == g]
            if len(own):
                row = seeds[g] if near[np.flatnonzero(rows == seeds[g])[0]] == g else own[0]
                todo.append((len(nodes), own))
                nodes.append([int(row), 0.0, float(far(np.array([row]), centre)[0]), 0, 0, True])
                nodes[node][4] += 1
    order = np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = np.array([tuple(n) for n in nodes], _NODE)
    found["row"] = place[found["row"]]
    return order, found, np.concatenate(distance)


class Page:
    def __init__(self, ids: bytes, rows: bytes, nodes: bytes, distance: bytes, width: int, most: float):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(rows, np.int64).reshape(-1, width)
        self.nodes = np.frombuffer(nodes, _NODE)
        self.distance = np.frombuffer(distance, np.float64)
        self.x = lifted(self.rows, most)
        self.parts = {k: np.ascontiguousarray(self.nodes[k]) for k in _NODE.names}


def search(pages: list[Page], own: int, query: np.ndarray, k: int, most: float, least: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """((-score, id) of the k best rows but ``own``, best first; ties to smaller ids) and how many rows were compared.

    Rows of a score under ``least`` need not be found.
    """
    q = query.astype(np.float64)
    size = float(q @ q)
    q = np.append(q, 0.0)
    slack = 1e-7 * (1 + size + most)
    bound = lambda low: (size + most - np.maximum(low, 0) ** 2) / 2 + slack  # noqa: E731  of the score at that distance or more
    heap, best, compared = [], [], 0
    for p, page in enumerate(pages):
        d = float(np.sqrt(((page.x[page.parts["row"][0]] - q) ** 2).sum()))
        heap.append((-float(bound(d - page.parts["radius"][0])), p, 0, d))
    heapq.heapify(heap)
    while heap:
        high, p, node, d = heapq.heappop(heap)
        if -high < least:
            break
        page, parts = pages[p], pages[p].parts
        first, count = parts["first"][node], parts["count"][node]
        if parts["leaf"][node]:
            at = first + np.flatnonzero(bound(np.abs(page.distance[first : first + count] - d)) >= least)
            compared += len(at)
            scores = page.rows[at] @ query
            good = np.flatnonzero((scores >= least) & (page.ids[at] != own))
            if len(good):
                best = sorted(best + list(zip((-scores[good]).tolist(), page.ids[at[good]].tolist())))[:k]
                least = max(least, -best[-1][0]) if len(best) == k else least
        else:
            at = first + np.flatnonzero(bound(np.abs(parts["parent"][first : first + count] - d) - parts["radius"][first : first + count]) >= least)
            far = np.sqrt(((page.x[parts["row"][at]] - q) ** 2).sum(axis=1))
            for high, child, e in zip(bound(far - parts["radius"][at]).tolist(), at.tolist(), far.tolist()):
                if high >= least:
                    heapq.heappush(heap, (-high, p, child, e))
    return best, compared


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it) of each lifted row."""
    near = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


def _placed(centres, most: float, width: int):
    """Each row with its pivot and its distance to it."""

    def run(batches):
        for batch in batches:
            near, distance = _nearest(lifted(_matrix(batch.column("vector"), width), most), centres.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(distance)], ["vec_id", "vector", "pivot", "distance"])

    return run


def _page(most: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _matrix(table.column("vector"), width)
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        order, nodes, distance = build_tree(lifted(rows, most))
        columns = {"shell": table.column("shell")[0].as_py(), "part": table.column("part")[0].as_py(), "ids": ids[order].tobytes(), "rows": rows[order].tobytes(), "nodes": nodes.tobytes(), "distance": distance.tobytes()}
        return pa.table({k: [v] for k, v in columns.items()}, pa.schema([("shell", pa.int32()), ("part", pa.int32()), *((k, pa.binary()) for k in ("ids", "rows", "nodes", "distance"))]))

    return run


class Root:
    """The shells of all pivots, a bounded table: pivot, least and largest distance, pages and page group of each."""

    def __init__(self, centres: np.ndarray, shells: list[tuple[int, float, float, int]]):
        self.centres = centres
        self.pivot = np.array([s[0] for s in shells], np.int64)
        self.low, self.high = (np.array([s[k] for s in shells]) for k in (1, 2))
        self.pages = np.maximum(1, -(-np.array([s[3] for s in shells], np.int64) // PAGE_ROWS))
        self.group = (np.cumsum(self.pages) - self.pages) // PAGES_A_TASK  # shells that follow one another share a task

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Of queries, lifted with a zero, to each pivot."""
        q = np.concatenate([rows.astype(np.float64), np.zeros((len(rows), 1))], axis=1)
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1)[None, :] - 2 * q @ self.centres.T, 0))

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The shell of the nearest pivot that is nearest to each query's distance."""
        d = self.distances(rows)
        near = d.argmin(axis=1)
        out = np.zeros(len(rows), np.int64)
        for i, p in enumerate(near):
            own = np.flatnonzero(self.pivot == p)
            own = own if len(own) else np.arange(len(self.pivot))
            gap = np.maximum(0, np.maximum(self.low[own] - d[i, p], d[i, p] - self.high[own]))
            out[i] = own[gap.argmin()]
        return out

    def reach(self, rows: np.ndarray, least: np.ndarray, most: float) -> np.ndarray:
        """Which shells can hold a score of ``least`` or more, for each query."""
        d = self.distances(rows)[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.low[None, :] - d, d - self.high[None, :]))
        size = (rows.astype(np.float64) ** 2).sum(axis=1)[:, None]
        return (size + most - gap * gap) / 2 + 1e-7 * (1 + size + most) >= least[:, None]


def _homes(root, width: int):
    def run(batches):
        for batch in batches:
            shell = root.value.home(_matrix(batch.column("vector"), width)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(shell.astype(np.int32))], ["vec_id", "vector", "shell"])

    return run


def _kth(k: int, most: float, width: int):
    """The k-th score of each query in one page, null if the page has fewer, and how many rows were compared for it."""

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        forest = [Page(*values, width, most) for values in zip(*(pages.column(c).to_pylist() for c in ("ids", "rows", "nodes", "distance")))]
        least, compared = [], []
        for own, vector in zip(queries.column("vec_id").to_pylist(), _matrix(queries.column("vector"), width)):
            best, n = search(forest, own, vector, k, most) if forest else ([], 0)
            least.append(-best[-1][0] if len(best) == k else None)
            compared.append(n)
        return pa.table({"vec_id": queries.column("vec_id"), "vector": queries.column("vector"), "q": queries.column("q"), "least": pa.array(least, pa.int64()), "compared": pa.array(compared, pa.int64())})

    return run


def _sent(root, most: float, width: int):
    """Each query with the page groups that it must go to."""

    def run(batches):
        for batch in batches:
            rows, shape = _matrix(batch.column("vector"), width), root.value
            least = batch.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            groups = [np.unique(shape.group[hit]).astype(np.int32) for hit in shape.reach(rows, least, most)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "q", "least")), pa.array(groups, pa.list_(pa.int32()))], ["vec_id", "vector", "q", "least", "groups"])

    return run


def _answers(k: int, most: float, width: int):
    """The best rows of each query in some pages, and a row without vec_id that says how many rows were compared."""

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        forest = [Page(*values, width, most) for values in zip(*(pages.column(c).to_pylist() for c in ("ids", "rows", "nodes", "distance")))]
        vectors = _matrix(queries.column("vector"), width)
        out = {"query_id": [], "vec_id": [], "score": [], "compared": []}
        for own, vector, least in zip(queries.column("vec_id").to_pylist(), vectors, queries.column("least").to_pylist()) if forest else ():
            best, compared = search(forest, own, vector, k, most, -np.inf if least is None else least)
            for row in [(own, None, None, compared), *((own, i, -score, None) for score, i in best)]:
                for name, x in zip(out, row):
                    out[name].append(x)
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k largest inner products with ``rows``; ties to smaller vec_ids.

    Both tables are (vec_id, vector of whole numbers), see ``whole_vectors``; shorter vectors count as filled up with zeros.
    Rows of the query's own vec_id are left out. Repeated rows are candidates one by one; a repeated query is asked
    once, by its first vector in order. Fewer than k rows give all; no rows or no queries give an empty result.

    The index holds every row. The root is a table of at most ``pivots`` pivots with ``SHELLS`` shells each, whatever the number of rows; a shell with more rows than a page is
    split by a hash, and its pages share the shell's bounds. Queries of neighbouring home shells make a group. Page groups and query groups form a grid, of which only the cells exist
    that the root sends a query to; each is a task of bounded size, and sends k rows for each query on.
    """
    found, _ = _searched(rows, queries, k, pivots)
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def comparisons(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id and compared: the rows whose inner product with the query ``top_k`` computes, in both rounds and in all tasks."""
    found, first = _searched(rows, queries, k, pivots)
    both = found.where("vec_id is null").select("query_id", "compared").unionByName(first.select(F.col("vec_id").alias("query_id"), "compared"))
    return both.groupBy("query_id").agg(F.sum("compared").alias("compared"))


def _query_groups(homes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(shell, first group, groups) from (shell, its queries): neighbouring shells share a group, a shell with more queries than a task takes has several."""
    out, before = [], 0
    for shell, n in homes:
        out.append((shell, before // QUERIES_A_TASK, -(-n // QUERIES_A_TASK)))
        before += n
    return out


def _searched(rows: DataFrame, queries: DataFrame, k: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(what ``_answers`` gives for every task, what ``_kth`` gives for every query)."""
    spark = rows.sparkSession
    shape = rows.agg(F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.count("*")).first()
    wide = queries.agg(F.max(F.size("vector")), F.count("*")).first()
    if not shape[2] or not wide[1]:
        return spark.createDataFrame([], ANSWER), spark.createDataFrame([], FIRST)
    width, most = max(shape[0], wide[0], 1), float(shape[1])
    wanted = max(16, min(pivots, shape[2] // PAGE_ROWS))
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(wanted).select("vector").toPandas()["vector"].tolist()
    pivot_rows = np.zeros((len(chosen), width), np.int64)
    for i, v in enumerate(chosen):
        pivot_rows[i, : len(v)] = v
    centres = lifted(pivot_rows, most)
    near = durable(rows.mapInArrow(_placed(spark.sparkContext.broadcast(centres), most, width), "vec_id long, vector array<long>, pivot int, distance double"))
    cuts = near.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", F.array(*(F.lit(j / SHELLS) for j in range(1, SHELLS))), 1000).alias("at"))
    # a pivot has a shell for each page of its rows, cut at every so many of the quantiles
    step = F.greatest(F.floor(SHELLS / F.ceil(F.col("n") / PAGE_ROWS)), F.lit(1)).cast("int")
    edges = cuts.select("pivot", F.array_sort(F.array_distinct(F.filter("at", lambda x, i: (i + 1) % step == 0))).alias("edges"))  # a row for each pivot
    shelled = near.join(F.broadcast(edges), "pivot").withColumn("shell", F.size(F.filter("edges", lambda e: e < F.col("distance"))))
    sizes = shelled.groupBy("pivot", "shell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).orderBy("pivot", "shell").collect()  # pivots x SHELLS rows at most
    root = Root(centres, [(r["pivot"], r["low"], r["high"], r["n"]) for r in sizes])
    numbers = spark.createDataFrame([(r["pivot"], r["shell"], i, int(root.pages[i]), int(root.group[i])) for i, r in enumerate(sizes)], "pivot int, shell int, number int, parts int, p int")
    split = shelled.join(F.broadcast(numbers), ["pivot", "shell"]).select("vec_id", "vector", F.col("number").alias("shell"), "parts")
    split = split.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("parts")).cast("int"))
    pages = durable(split.groupBy("shell", "part").applyInArrow(_page(most, width), "shell int, part int, ids binary, rows binary, nodes binary, distance binary"))

    shared = spark.sparkContext.broadcast(root)
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    at_home = durable(asked.mapInArrow(_homes(shared, width), "vec_id long, vector array<long>, shell int"))
    homes = [(r["shell"], r["count"]) for r in at_home.groupBy("shell").count().orderBy("shell").collect()]  # pivots x SHELLS rows at most
    grouped = F.broadcast(spark.createDataFrame(_query_groups(homes), "shell int, q int, groups int"))
    parts = F.broadcast(numbers.select(F.col("number").alias("shell"), "parts", "p"))
    lot = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("groups")).cast("int")
    at_home = at_home.join(grouped, "shell").join(parts, "shell").select("vec_id", "vector", "shell", (F.col("q") + lot).alias("q"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    first = durable(pages.groupBy("shell", "part").cogroup(at_home.groupBy("shell", "part")).applyInArrow(_kth(k, most, width), FIRST))
    sent = first.mapInArrow(_sent(shared, most, width), "vec_id long, vector array<long>, q int, least long, groups array<int>")
    sent = durable(sent.withColumn("p", F.explode("groups")).drop("groups"))
    asking = sent.select(F.col("p").alias("to"), F.col("q").alias("group")).distinct()
    held = pages.join(parts, "shell").join(asking, F.col("p") == F.col("to"))  # a page goes to the query groups that have a query for it
    return held.groupBy("to", "group").cogroup(sent.groupBy("p", "q")).applyInArrow(_answers(k, most, width), ANSWER), first


def digest(embeddings: DataFrame) -> DataFrame:
    """op3's contract."""
    rows = whole_vectors(embeddings, "vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.vector) = 0 OR len(c.vector) = 0 THEN 0 ELSE CAST(list_inner_product(q.vector, c.vector) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
