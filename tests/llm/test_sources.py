import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightledger.llm.sources import ORACLE, digest, draws, mix_sources, quotas, shard_of, source_targets

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows():
    rng = random.Random(9)
    out = [(1, None, "b", 0), (2, "", "b", 0), (3, " \n", None, 0), (4, "x y", None, 0), (5, "one", "é", 0), (5, "one", "é", 0), (6, "a b", "Z", 0), (None, "p q r", "Z", 0), (None, "p q", "Z", 0)]
    for i in range(10, 400):
        out.append((i, " ".join(["w"] * rng.randint(0, 90)), "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}", 0))
    return out + [(900, "w " * 30_000, "s1", 0)]


def water(sizes, weights):
    """Targets by sharing again and again."""
    pool, left, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while left:
        level = (pool - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in left}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return target


def test_mix_against_plain_python(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, shard int")
    found = mix_sources(docs, shard_rows=100).collect()
    assert len(found) == len(data)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, text, source, _ in data:
        sizes[source] = sizes.get(source, 0) + size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    source_of = {}
    for i, text, source, _ in data:
        source_of.setdefault((i, size(text)), source)
    taken = {}
    for r in found:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 6 * 16
    again = mix_sources(docs.repartition(7, "text"), shard_rows=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_oracle(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, shard int")
    base = duckdb.connect()
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source", "shard"]).astype({"doc_id": "Int64"})
    base.register("documents", documents)
    want = [tuple(r) for r in base.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})").fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in digest(docs).collect())


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(2)
    votes = [(shard, place, rng.choice([0.0, rng.uniform(0, 50), rng.uniform(0, 4000)])) for shard in range(40) for place in range(1, rng.randint(2, 30))]
    got = {(r.shard, r.place): r.quota for r in quotas(spark.createDataFrame(votes, "shard int, place int, vote double"), 10).collect()}
    for shard in range(40):
        own = [(p, v) for s, p, v in votes if s == shard]
        seats = dict.fromkeys([p for p, _ in own], 0)
        for _ in range(int(sum(v for _, v in own) / 10 + 0.5)):
            best = max(own, key=lambda x: (x[1] / (2 * seats[x[0]] + 1), -x[0]))
            seats[best[0]] += 1
        assert seats == {p: got[shard, p] for p, _ in own}


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mix_sources(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mix_sources(docs.limit(0)).count() == 0
    assert source_targets(docs.select("source", F.lit(3).cast("long").alias("size"))).count() == 2


def test_null_ids_and_repeated_rows_spread(spark):
    """Half of the ids null, a third of all rows one text of one id: shards are even, repeats are numbered once each, and the mix is the oracle's."""
    made = spark.range(30_000).selectExpr(
        "CASE WHEN id % 6 < 2 THEN 7 WHEN id % 2 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 6 < 2 THEN 'same text of all' ELSE concat('w ', id) END AS text", "CASE WHEN id % 6 < 2 THEN 'hot' ELSE concat('s', id % 3) END AS source"
    )
    found = draws(made, together=100)
    assert found.count() == 30_000 and found.select("draw").distinct().count() == 30_000
    shares = [r["count"] for r in found.groupBy(shard_of("draw", 10).alias("shard")).count().collect()]
    assert len(shares) == 10 and max(shares) < 3_300
    hot = [r["count"] for r in found.where("source = 'hot'").groupBy(shard_of("draw", 10).alias("shard")).count().collect()]
    assert sum(hot) == 10_000 and max(hot) < 1_200
    base = duckdb.connect()
    documents = made.toPandas().astype({"doc_id": "Int64"})
    base.register("documents", documents)
    want = [tuple(r) for r in base.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})").fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in digest(made).collect())
