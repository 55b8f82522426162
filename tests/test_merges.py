from nightledger.operators import cluster

TARGETS = "id long, name string, canonical_name string, object_type string"
SEEN = "target_id long, exposure_time double, frame_count int, observation_date string"


def seen(spark, ids):
    return spark.createDataFrame([(i, 60.0, 2, f"2024-01-{i % 27 + 1:02d}") for i in ids], SEEN)


def test_all_three_rules_and_what_they_link(spark):
    rows = [
        (1, "M  31", None, None), (2, "Andromeda", "M 31", "Galaxy"), (3, "Nebula (455mm)", "", None), (4, "Nebula", None, "Nebula"), (5, "Nebula (80MM) ", "NGC 7", "Cloud"),
        (6, "other", "M 31", None), (7, "alone", "", None), (8, None, None, None), (9, None, None, None), (10, "alone (x mm)", None, "Star"),
    ]
    targets = spark.createDataFrame(rows, TARGETS)
    keep = cluster.merge_duplicates(targets)
    assert {r.id: r.keep for r in keep.collect()} == {1: 1, 2: 1, 6: 1, 3: 3, 4: 3, 5: 3, 7: 7, 8: 8, 9: 9, 10: 10}
    kept, moved = cluster.merged_tables(targets, seen(spark, [2, 6, 6, 4, 7, 99]), keep)
    assert {r.id: (r.canonical_name, r.object_type, r.n_merged) for r in kept.collect()} == {1: ("M 31", "Galaxy", 2), 3: ("NGC 7", "Nebula", 2), 7: (None, None, 0), 8: (None, None, 0), 9: (None, None, 0), 10: (None, "Star", 0)}
    assert sorted(r.target_id for r in moved.collect()) == [1, 1, 1, 3, 7, 99]  # an observation of no target stays as it is


def test_a_kept_target_with_a_canonical_name_keeps_its_own_type(spark):
    targets = spark.createDataFrame([(1, "a", "M 1", None), (2, "b", "M 1", "Remnant")], TARGETS)
    kept = cluster.merged_tables(targets, seen(spark, []), cluster.merge_duplicates(targets))[0]
    assert [tuple(r) for r in kept.collect()] == [(1, "a", "M 1", None, 1)]


def test_plan_changes_nothing_and_names_its_problems(spark):
    targets = spark.createDataFrame([(i, f"t{i}", None, None) for i in range(1, 5)], TARGETS)
    merges = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (9, 1), (3, 9)], "source long, dest long")
    found = {(r.source, r.dest): (r.source_exposure, r.dest_frames, r.observations_moved, r.problem) for r in cluster.merge_plan(targets, seen(spark, [1, 1, 2]), merges).collect()}
    assert found == {(1, 2): (120.0, 2, 2, None), (2, 2): (60.0, 2, 0, "same target"), (9, 1): (None, 4, 0, "source not found"), (3, 9): (0.0, None, 0, "dest not found")}


def test_chains_circles_and_several_destinations(spark):
    targets = spark.createDataFrame([(i, f"t{i}", None, None) for i in range(1, 12)], TARGETS)
    chain, circle, several = [(4, 3), (3, 2), (2, 9)], [(5, 6), (6, 7), (7, 5)], [(8, 11), (8, 10)]
    merges = spark.createDataFrame(chain + circle + several + [(1, 99), (None, 1), (1, None)], "source long, dest long")
    kept, moved = cluster.merge_pairs(targets, seen(spark, range(1, 12)), merges)
    assert {r.id: r.total_frames for r in kept.collect()} == {1: 2, 9: 8, 5: 6, 10: 4, 11: 2}
    assert sorted(r.target_id for r in moved.collect()) == [1, 5, 5, 5, 9, 9, 9, 9, 10, 10, 11]
    assert {r.id: (r.first_date, r.last_date) for r in kept.collect()}[9] == ("2024-01-03", "2024-01-10")


def test_empty_tables(spark):
    targets, none = spark.createDataFrame([], TARGETS), spark.createDataFrame([], "source long, dest long")
    kept, moved = cluster.merge_pairs(targets, seen(spark, [1]), none)
    assert kept.count() == 0 and moved.count() == 1 and cluster.merge_duplicates(targets).count() == 0 and cluster.merge_plan(targets, moved, none).count() == 0
