import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nightledger.operators import groups, nearest
from nightledger.operators.nearest import k_nearest


def brute(rows, k):
    out = set()
    for g, i, x, y in rows:
        if g is None or x is None:
            continue
        near = sorted(((x - b) ** 2 + (y - c) ** 2, j) for h, j, b, c in rows if h == g and j != i and b is not None)
        out |= {(g, i, j, round(d, 6), r) for r, (d, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 6])
def test_matches_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(0, i, rng.uniform(0, 3000), rng.uniform(0, 2000)) for i in range(300)]
    rows += [(1, i, 5.0, 5.0) for i in range(12)] + [(2, 0, 1.0, 1.0)] + [(3, i, float(i), 0.0) for i in range(50)]  # one place, one star, a line
    rows += [(4, i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)] + [(4, 200 + i, rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)) for i in range(5)]  # a cluster and far stars
    rows += [(5, i, float(rng.randint(0, 5)), float(rng.randint(0, 5))) for i in range(80)]  # ties
    rows += [(None, 1, 0.0, 0.0), (0, 900, None, 1.0)]
    found = k_nearest(spark.createDataFrame(rows, "frame long, star long, x double, y double"), "frame", "star", k).collect()
    assert {(r.frame, r.star, r.near_star, round(r.distance2, 6), r["rank"]) for r in found} == brute(rows, k) and len(found) == len(brute(rows, k))


def test_compared_stars_stay_flat_as_a_frame_grows(spark):
    rng = random.Random(2)
    met = []
    for n in (1_000, 10_000):
        stars = spark.createDataFrame([(1, i, rng.uniform(0, 3000), rng.uniform(0, 2000)) for i in range(n)], "frame long, star long, x double, y double")
        placed = nearest._placed(stars, "frame", 6)
        met.append(nearest._met(placed, placed, "frame", "star", [], 0).count() / n)
    assert met[1] < 1.2 * met[0] < 200


def test_outliers_of_a_small_frame_are_kept(spark):
    rows = [(1, i, float(i), 0.0, 2.0 if i else 99.0) for i in range(6)] + [(2, i, float(i % 4), float(i // 4), 2.0 + i / 1000) for i in range(15)] + [(2, 99, 1.5, 1.5, 9.0)]
    got = {(r.frame, r.star): r.keep for r in groups.local_outliers(spark.createDataFrame(rows, "frame long, star long, x double, y double, fwhm double")).collect()}
    assert len(got) == len(rows) and [k for k, keep in got.items() if not keep] == [(2, 99)]
    empty = spark.createDataFrame([], "frame long, star long, x double, y double, fwhm double")
    assert k_nearest(empty, "frame", "star", 3).count() == 0


def test_pairs_of_the_first_round_are_not_shuffled(spark):
    rows = [(i % 40, i, float(i * 37 % 301), float(i * 53 % 211)) for i in range(4000)]
    points = spark.createDataFrame(rows, "frame long, star long, x double, y double")
    placed = nearest._placed(points, "frame", 6)
    met = nearest._met(placed, placed, "frame", "star", [], 0, 7)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("frame", "_ax", "_ay", "star").orderBy("distance2", "near_star")))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.rdd.getNumPartitions() == 7 and plan.count("REPARTITION_BY_NUM") == 2 and "Window" not in plan.split("SortMergeJoin")[1]
    assert "Exchange" not in plan.split("SortMergeJoin")[0]
