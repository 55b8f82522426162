import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from nightledger.operators import selection
from nightledger.operators.selection import numbered, order_statistics


@contextmanager
def many_ranges(spark):
    """Ranges of some KB, so that small tables have many."""
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def linear(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_statistics_match_sorted_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["big", "big", "big", None, "b", "one"]), rng.choice([1, None]), rng.choice([None, float(rng.randint(-9, 9)), rng.gauss(0, 1e6)]), rng.random()) for _ in range(900)] + [("nulls", 1, None, None)]
    asked = {"m": ("u", 0.5), "hi": ("u", 0.97), "least": ("u", 0.0), "most": ("v", 1.0), "upper": ("v", "upper")}
    with many_ranges(spark):
        got = {(r.a, r.b): r for r in order_statistics(spark.createDataFrame(rows, "a string, b int, u double, v double"), ["a", "b"], asked).collect()}
    for key in {(a, b) for a, b, _, _ in rows}:
        u, v = ([r[k] for r in rows if r[:2] == key and r[k] is not None] for k in (2, 3))
        if not u and not v:
            assert key not in got
            continue
        for name, share in (("m", 0.5), ("hi", 0.97), ("least", 0.0)):
            assert got[key][name] == pytest.approx(linear(u, share), rel=1e-12) if u else got[key][name] is None
        assert got[key].most == max(v) and got[key].upper == sorted(v)[len(v) // 2]


def test_one_group_is_dealt_over_many_ranges(spark):
    with many_ranges(spark):
        rows = spark.range(2_000_000).select(F.lit("all").alias("g"), (F.xxhash64("id") / 1e18).alias("v"))
        sizes = [r.n for r in selection._ranges(rows, ["g"], ["v"]).groupBy("g", "_piece").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 12 and max(sizes) < 2_000_000 / 6
        found = order_statistics(rows, ["g"], {"m": ("v", 0.5), "q": ("v", 0.999)}).first()
    want = rows.agg(F.expr("percentile(v, array(0.5, 0.999))").alias("p")).first().p
    assert (found.m, found.q) == pytest.approx(tuple(want), rel=1e-12)


def test_numbers_of_one_name_come_from_many_ranges(spark):
    with many_ranges(spark):
        rows = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("n"), F.col("id"))).otherwise(F.when(F.col("id") % 3 > 0, "hot")).alias("name"), F.xxhash64("id").alias("at"), "id")
        got = numbered(rows, ["name"], ["at", "id"])
        sizes = [r.n for r in selection._ranges(rows, ["name"], ["at", "id"]).where("name = 'hot'").groupBy("_piece").agg(F.count("*").alias("n")).collect()]
        same = got.join(rows.selectExpr("id", "row_number() over (partition by name order by at, id) as want"), "id").where("number = want").count()
    assert same == 300_000 and len(sizes) >= 6 and max(sizes) < sum(sizes) / 4


def test_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert order_statistics(empty, ["k"], {"m": ("v", 0.5)}).count() == 0 and numbered(empty, ["k"], ["v"]).columns == ["k", "v", "number"]
    rows = spark.createDataFrame([(None, 2.0), (None, 1.0), ("a", 5.0)], "k string, v double")
    assert sorted((r.k or "", r.v, r.number) for r in numbered(rows, ["k"], [F.desc("v")]).collect()) == [("", 1.0, 2), ("", 2.0, 1), ("a", 5.0, 1)]
