import random

import pytest
from pyspark.sql import functions as F

from nightledger.operators.calibration import PROFILES, match_profile

COLUMNS = "path string, instrument string, binning int, gain double, offset double, exposure double, temperature double, focal_length double, filter string"


def frames(rng, n, mark, profile):
    some = lambda *x: rng.choice([None, *x]) if rng.random() < 0.2 else rng.choice(x)
    value = lambda low, high: None if rng.random() < 0.1 else round(rng.uniform(low, high), rng.choice([0, 1, 3]))
    return [(f"{mark}{i:05}", rng.choice(["A", " a", "B"]), 1, some(0.0, 100.0) if profile in ("dark", "bias") else value(0, 900), some(0.0, 10.0) if profile == "bias" else value(0, 200), rng.choice([30.0, 30.004, 60.0]) if profile == "dark" else value(0, 1500), value(-40, 40), value(300, 2500), some("L", "R")) for i in range(n)]


@pytest.mark.parametrize("profile", sorted(PROFILES))
@pytest.mark.parametrize("k", [1, 5])
def test_left_out_masters_change_nothing(spark, profile, k):
    rng = random.Random(f"{profile}{k}")
    lights, masters = (spark.createDataFrame(frames(rng, n, m, profile), COLUMNS) for n, m in ((80, "l"), (400, "m")))
    rows = lambda **how: sorted((r.light, r["rank"], r.master, r.score, r.n_warnings, sorted(r.matched.items())) for r in match_profile(lights, masters, profile, k, **how).collect())
    want = rows()
    assert len(want) > 60 * k / 5 and rows(pairs=0) == want


def test_compared_candidates_stay_far_below_the_product(spark):
    n = 20_000
    of = lambda mark, shift: spark.range(n).select(F.concat(F.lit(mark), F.lpad("id", 6, "0")).alias("path"), F.lit("A").alias("instrument"), F.lit(1).alias("binning"), F.lit(0.0).alias("gain"), F.lit(10.0).alias("offset"), F.lit(30.0).alias("exposure"), (F.col("id") * 37 % n / n * 40 - 20 + shift).alias("temperature"))
    frontiers = []
    found = match_profile(of("l", 0.0001), of("m", 0.0), "dark", 5, frontiers=frontiers)
    assert found.count() == 5 * n and found.where("score < 1").count() == 0
    assert sum(f.count() for f in frontiers) < n * 250  # of n * n pairs
    some = found.where("light = 'l000000'").orderBy("rank").collect()
    want = of("m", 0.0).where("abs(temperature + 19.9999) <= 2").orderBy("path").limit(5).collect()
    assert [r.master for r in some] == [r.path for r in want]
