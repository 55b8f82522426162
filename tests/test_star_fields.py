import heapq
import random

import pytest
from pyspark.sql import functions as F

from nightledger.operators import nearest
from nightledger.plans import sky_groups  # noqa: F401
from nightledger.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Orders of five lines; frame 3 has none that is an order's first. Some have no discount, so no FWHM."""
    rows = [(o, (o * 7 + n * 5) % 90, n % 4, n, 100.0 * n + o, ((o * 3 + n) % 11) / 100 if (o + n) % 13 else None) for o in range(40) for n in range(1, 6)]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def oracle_of(folder):
    import duckdb

    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return base


def test_outliers_are_judged_for_every_line(spark, lines):
    folder, rows = lines
    name = "F12_local_outliers"
    assert compare(spark, oracle_of(folder), folder, QUERIES[name], ORACLES[name]) == len(rows)


def test_grids_take_every_line(spark, lines):
    folder, rows = lines
    name = "F13_fwhm_grid"
    assert compare(spark, oracle_of(folder), folder, QUERIES[name], ORACLES[name]) == 16 * len({r[2] for r in rows})


def test_no_table_of_stars_is_broadcast(spark, tmp_path):
    # a compressed file of many stars is small, so that Spark would take it for a table to broadcast
    spark.range(200_000).selectExpr("id % 300 AS frame", "id AS star", "cast(id * 37 % 3001 AS double) AS x", "cast(id * 53 % 2003 AS double) AS y").write.parquet(f"{tmp_path}/stars")
    plan = nearest._placed(spark.read.parquet(f"{tmp_path}/stars"), "frame", 6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("k", [1, 6])
def test_nearest_over_many_tiles(spark, k):
    rng = random.Random(k)
    even = [(1, i, rng.uniform(0, 3000), rng.uniform(0, 2000)) for i in range(1500)] + [(1, 5000 + i, 3000.0 * (i % 2), 2000.0 * (i // 2)) for i in range(4)]
    uneven = [(2, i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(300)] + [(2, 1000 + i, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for i in range(900)]
    strip = [(3, i, rng.uniform(0, 1e6), 0.0) for i in range(400)] + [(4, i, float(rng.randint(0, 12)), float(rng.randint(0, 12))) for i in range(700)]
    rows = even + uneven + strip
    stars = spark.createDataFrame(rows, "frame long, star long, x double, y double")
    assert k > 1 or nearest._placed(stars, "frame", k).groupBy("frame").agg(F.max("_tx").alias("t")).where("frame <> 3").agg(F.min("t")).first()[0] >= 2
    got = {}
    for r in nearest.k_nearest(stars, "frame", "star", k).collect():
        got.setdefault((r.frame, r.star), {})[r["rank"]] = r.near_star
    frames = {}
    for f, i, x, y in rows:
        frames.setdefault(f, []).append((i, x, y))
    for f, held in frames.items():
        for i, x, y in held:
            near = heapq.nsmallest(k, (((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in held if j != i))
            assert got[f, i] == {n: j for n, (_, j) in enumerate(near, 1)}
