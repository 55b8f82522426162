import math
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from nightledger.operators import cluster, joins, ordered, upserts
from nightledger.operators.components import connected_components
from nightledger.operators.images import compare_profiles
from nightledger.streaming.imports import stream_exposures, stream_session_summary, stream_weather


def distance(a, b):
    (r1, d1), (r2, d2) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def sky(n, seed):
    rng = random.Random(seed)
    centres = [(rng.uniform(0, 360), rng.choice([-89.9, -60, 0, 45, 80, 89.8])) for _ in range(12)] + [(359.9, 10.0)]
    out = []
    for i in range(n):
        ra, dec = rng.choice(centres)
        out.append((i, (ra + rng.gauss(0, 0.7)) % 360, max(-90.0, min(90.0, dec + rng.gauss(0, 0.5)))))
    return out


def test_pairs_within_equals_all_pairs(spark):
    rows = sky(260, 1)
    for eps in (0.3, 2.0):
        want = {(i, j) for i, *p in rows for j, *q in rows if i < j and distance(p, q) <= eps}
        found = joins.pairs_within(spark.createDataFrame(rows, "id long, ra_deg double, dec_deg double"), eps).collect()
        assert len(found) == len(want) and {(r.id_a, r.id_b) for r in found} == want


def test_clusters_equal_brute_force(spark):
    rows, eps = sky(200, 2), 0.4
    near = {i: {j for j, *q in rows if distance(p, q) <= eps} for i, *p in rows}
    for least in (1, 4):
        cores = {i for i in near if len(near[i]) >= least}
        name, todo = {}, sorted(cores)
        for start in todo:
            if start not in name:
                stack = [start]
                while stack:
                    k = stack.pop()
                    if k not in name:
                        name[k] = start
                        stack += near[k] & cores
        want = {i: name.get(i, min((name[j] for j in near[i] & cores), default=i)) for i in near}
        found = cluster.cluster_targets(spark.createDataFrame(rows, "id long, ra_deg double, dec_deg double"), eps, least).collect()
        assert {r.id: r.cluster for r in found} == want and {r.id for r in found if r.core} == cores


def test_copies_of_a_position_are_one_node(spark):
    spots = [s for s in sky(90, 3) if abs(s[2]) < 89.9][:40]  # at a pole all right ascensions are one place
    rows = [(k * 40 + i, *spots[i][1:]) for k in range(30) for i in range(40)] + [(9000, None, 1.0), (9001, None, 1.0), (9002, float("nan"), 1.0)]
    targets = spark.createDataFrame(rows, "id long, ra_deg double, dec_deg double")
    near = {(i, j) for i, *p in rows[:1200] for j, *q in rows[:1200] if i < j and distance(p, q) <= 2.0}
    found = joins.pairs_within(targets, 2.0)
    got = found.collect()
    assert len(got) == len(near) and {(r.id_a, r.id_b) for r in got} == near
    assert joins.place_pairs(joins.places_of(targets).selectExpr("place as id", "_ra as ra_deg", "_dec as dec_deg"), 2.0).count() <= 40 * 39 / 2
    clusters = {r.id: (r.cluster, r.core) for r in cluster.cluster_targets(targets, 0.0001, 30).collect()}
    assert len(clusters) == len(rows) and all(clusters[i] == (i % 40, True) for i in range(1200)) and all(clusters[i] == (i, False) for i in (9000, 9001, 9002))


def test_growing_sides_are_not_broadcast(spark):
    targets = spark.createDataFrame(sky(40, 3), "id long, ra_deg double, dec_deg double")
    assert "Broadcast" not in joins.place_pairs(targets, 1.0)._jdf.queryExecution().sparkPlan().toString()


def test_orphans_meet_all_matches_of_a_common_name(spark):
    rows = [(i, "a b" if i % 2 else "c", None if i % 3 == 0 else ("a  b" if i % 2 else "d")) for i in range(5000)] + [(9999, "e", ""), (None, "a b", "a b")]
    found = ordered.orphan_matches(spark.createDataFrame(rows, "id long, name string, canonical_name string"))
    orphans, named = [i for i in range(5000) if i % 3 == 0 and i % 2], [i for i in range(5000) if i % 3 and i % 2]
    got = found.agg(F.count("*"), F.countDistinct("orphan_id", "match_id"), F.min(F.col("match_id") % 2)).first()
    assert tuple(got) == (len(orphans) * len(named), len(orphans) * len(named), 1)
    joins_of = spark.createDataFrame([(i, "k") for i in range(5000)], "id long, k string")
    assert joins.dealt_lists(joins_of, "k", "id").selectExpr("max(size(ids))").first()[0] < 1400


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == dict.fromkeys(range(301), 0) | {1000: 1000, 2000: 2000, 2001: 2000}


def test_nearest_join_takes_the_nearest(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    times = lambda n: [start + timedelta(seconds=rng.randint(0, 4000)) for _ in range(n)]
    left = [(i, "a" if i % 3 else None, t) for i, t in enumerate(times(60))] + [(99, "a", None)]
    right = [(i, "a", t, float(i)) for i, t in enumerate(times(40))] + [(77, "b", start, 1.0), (78, "a", None, 2.0)]
    l = spark.createDataFrame(left, "id long, folder string, timestamp timestamp")
    r = spark.createDataFrame(right, "rid long, folder string, timestamp timestamp, temperature double")
    found = {x.id: x for x in joins.nearest_join(l, r, "timestamp", ["folder"], ["temperature"], 30.0, "id", "rid").collect()}
    assert len(found) == len(left)
    for i, folder, t in left:
        gaps = [abs((u - t).total_seconds()) for _, f, u, _ in right if f == folder and u and t]
        best = min(gaps, default=None)
        assert found[i].gap_seconds == (best if best is not None and best <= 30 else None)


def test_upserts_twice_change_nothing(spark):
    base = spark.createDataFrame([(1, "x", None, 1.0), (2, "y", "t", 2.0)], "seq long, filter string, telescope string, e double")
    new = spark.createDataFrame([(3, "x", "", 5.0), (4, "z", "t", 6.0)], "seq long, filter string, telescope string, e double")
    once = upserts.upsert_replace(base, new, ["filter", "telescope"], "seq")
    twice = upserts.upsert_replace(once, new, ["filter", "telescope"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(2, "y", "t", 2.0), (3, "x", "", 5.0), (4, "z", "t", 6.0)]
    kept = upserts.insert_ignore(base, new, ["filter", "telescope"], "seq")
    assert kept.count() == 4 and upserts.insert_ignore(kept, new, ["filter", "telescope"], "seq").count() == 4


def test_profiles_of_unequal_length(spark):
    a = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0]
    b = {1: [2.0, 6.0, 1.0], 2: [5.0], 3: a}
    rows = lambda series: spark.createDataFrame([(g, k, x) for g, s in series.items() for k, x in enumerate(s)], "g int, k int, v double")
    got = {r.g: r for r in compare_profiles(rows({g: a for g in (1, 2, 3, 4)}), rows(b), "g", "k", "v").collect()}
    assert set(got) == {1, 2, 3}
    u = (np.array(a) - 1) / 7
    w = np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 3), b[1])
    w = (w - w.min()) / (w.max() - w.min())
    one = got[1]
    assert one.n == 7 and np.allclose([one.rmse, one.mae, one.r, one.peak_diff, one.mean_diff], [np.sqrt(np.mean((u - w) ** 2)), np.abs(u - w).mean(), np.corrcoef(u, w)[0, 1], 0, u.mean() - w.mean()])
    assert (got[2].r, got[2].peak_diff) == (0.0, 1.0) and np.isclose(got[2].mean_diff, u.mean())
    assert got[3].rmse == 0 and np.isclose(got[3].r, 1)


def test_streamed_weather_comes_once(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 18) + timedelta(minutes=k), t, 1.0) for k in range(30) for t in ("a", "b")]
    frame = spark.createDataFrame(rows + rows[:7], "timestamp timestamp, telescope string, temperature double")
    frame.write.parquet(f"{tmp_path}/in")
    stream_weather(spark, f"{tmp_path}/in", frame.schema).writeStream.format("memory").queryName("readings").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select * from readings").count() == 60


def test_streamed_summary_equals_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1, 18)
    rows = [(start + timedelta(hours=k), f"f{k % 50}", 60.0) for k in range(200)]
    frame = spark.createDataFrame(rows + rows[:10], "timestamp timestamp, file_path string, exposure_seconds double")
    frame.write.parquet(f"{tmp_path}/in")
    streamed = stream_session_summary(stream_exposures(spark, f"{tmp_path}/in", frame.schema))
    streamed.writeStream.format("memory").queryName("nights").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.session_date: (r.n_exposures, r.total_seconds) for r in spark.sql("select * from nights").collect()}
    night = F.to_date(F.col("timestamp") - F.expr("INTERVAL 12 HOURS"))
    want = {r.d: (r.n, r.s) for r in frame.dropDuplicates(["timestamp", "file_path"]).groupBy(night.alias("d")).agg(F.count("*").alias("n"), F.sum("exposure_seconds").alias("s")).collect()}
    assert got and all(want[d] == x for d, x in got.items())
