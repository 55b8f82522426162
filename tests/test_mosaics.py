import math
import statistics

from nightledger.functions import naming
from nightledger.operators import calibration, groups, joins, selection, signals

FRAMES = "id long, ra_deg double, dec_deg double"


def test_largest_mosaic_is_a_grid_from_the_south_along_right_ascension(spark):
    # 2 x 3 panels of a degree across 0 h, some with repeated frames; a smaller group and a lone frame elsewhere
    spots = [((359.5 + c) % 360, r * 1.0) for r in (0, 1) for c in (0, 1)]
    rows = [(k, *spots[k % 4]) for k in range(13)] + [(100, 90.0, 40.0), (101, 90.5, 40.0), (200, 180.0, -70.0), (300, None, 1.0), (301, 1.0, None)]
    frames = spark.createDataFrame(rows, FRAMES)
    found = {r.id: (r.group, r.panel) for r in groups.mosaic_panels(frames, 3.0, largest=True).collect()}
    assert found == {k: (0, f"R{k % 4 // 2 + 1}C{k % 2 + 1}") for k in range(13)}
    every = {r.id: (r.group, r.panel) for r in groups.mosaic_panels(frames, 3.0).collect()}
    assert set(every) == {*range(13), 100, 101, 200} and every[200] == (200, "R1C1") and every[101][0] == 100
    centres = {r.panel: (r.n_files, r.dec_deg) for r in groups.panel_centres(frames, groups.mosaic_panels(frames, 3.0, largest=True)).collect()}
    assert centres == {"R1C1": (4, 0.0), "R1C2": (3, 0.0), "R2C1": (3, 1.0), "R2C2": (3, 1.0)}


def test_tiles_count_pairs_of_frames_not_of_positions(spark):
    # ten frames at 0, one at 1 and one at 3 degrees: of the 21 pairs apart eleven are 1 or 2 degrees, so the tile is 2 or 3 by frames
    rows = [(k, 10.0, 0.0) for k in range(10)] + [(10, 11.0, 0.0), (11, 13.0, 0.0)]
    apart = sorted([1.0] * 10 + [3.0] * 10 + [2.0])
    tile = statistics.median(apart)
    found = {r.id: r.col for r in groups.mosaic_panels(spark.createDataFrame(rows, FRAMES)).collect()}
    plane = {k: math.degrees(math.tan(math.radians(ra - 10.0))) for k, ra, _ in rows}
    assert found == {k: round(x / tile) for k, x in plane.items()}


def test_empty_and_single(spark):
    assert groups.mosaic_panels(spark.createDataFrame([], FRAMES), largest=True).count() == 0
    assert [r.panel for r in groups.mosaic_panels(spark.createDataFrame([(5, 1.0, 2.0)], FRAMES), largest=True).collect()] == ["R1C1"]


HEADER = "path string, naxis1 int, naxis2 int, cdelt1 double, cdelt2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double"


def test_field_takes_one_sample_of_each_panel(spark):
    panels = spark.createDataFrame([("a", "R1C1", 0, 0), ("b", "R1C1", 0, 0), ("c", "R1C2", 0, 1), ("d", "R1C3", 0, 2)], "path string, panel string, row int, col int")
    headers = [("a", 1000, 500, -0.001, 0.001, None, None, None, None), ("b", 9000, 9000, 1.0, 1.0, None, None, None, None), ("c", 1000, 500, None, None, 0.0003, 0.0004, 0.0, 0.002), ("d", 0, 500, 1.0, 1.0, None, None, None, None)]
    assert tuple(groups.mosaic_field(panels, spark.createDataFrame(headers, HEADER)).first()) == (3, 4, 1, 3, round(0.75 * 3 * 60, 1), round(0.75 * 60, 1))
    assert tuple(groups.mosaic_field(panels, spark.createDataFrame([], HEADER)).first()) == (3, 4, 1, 3, None, None)


def test_weighted_order_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 1), ("b", 4.0, 0), ("c", 2.0, 1), ("c", None, 5)], "g string, x double, n int")
    found = {r.g: r.m for r in selection.order_statistics(rows, ["g"], {"m": ("x", 0.5)}, "n").collect()}
    assert found["a"] == statistics.median([1, 1, 1, 5, 5, 9]) and found["c"] == 2.0 and found.get("b") is None


def test_flats_by_setup_and_pending(spark):
    keys = "night date, telescope string, camera string, filter string, binning int, rotation int, n_files long"
    rows = [(None, "T", None, "L", 1, 0, 3), (None, "T", None, "R", 1, 0, 2), (None, "U", "C", "L", 1, None, 1)]
    held = spark.createDataFrame(rows, keys)
    masters = held.where("filter = 'L'")
    assert [r.filter for r in calibration.pending_flats(held, masters).collect()] == ["R"]
    found = {r.telescope: (r.n_groups, r.n_files, r.filters, r.masters_created, r.masters_pending) for r in calibration.flats_by(held, masters, ["telescope", "camera"]).collect()}
    assert found == {"T": (2, 5, ["L", "R"], 1, 1), "U": (1, 1, ["L"], 1, 0)}


def test_resolution_goes_by_steps(spark):
    rows = [
        (1, "M 31", "Andromeda", '{"main_id": "NGC 224", "aliases": ["UGC 454", "m  33"]}'), (2, "M 33", "Triangulum", "not json"), (3, "Other", "M 31", '{"aliases": "UGC 454"}'), (4, "x", None, '{"main_id": "ugc454"}'), (5, "", None, '{"main_id": "", "aliases": [null, ""]}'),
    ]
    targets = spark.createDataFrame(rows, "id long, name string, canonical_name string, data string")
    asked = [(1, "M 31"), (2, "m31"), (3, "M33"), (4, "ugc 454"), (5, "NGC224"), (6, ""), (7, None), (8, "nothing"), (9, "M 31")]
    found = {r.k: (r.id, r.step) for r in joins.resolve_local(spark.createDataFrame(asked, "k int, asked string"), targets, data="data").collect()}
    assert found == {1: (1, 1), 2: (1, 2), 3: (2, 2), 4: (1, 3), 5: (1, 3), 6: (None, None), 7: (None, None), 8: (None, None), 9: (1, 1)}


def test_containing_equals_all_pairs(spark):
    names = ["", "a", "ab", "abc", "xabcx", "bca", "Hα narrow", "α", "cabcab", None, "zzz", "abcd" * 300]
    held = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "part string, k int")
    holders = spark.createDataFrame([(n, -k) for k, n in enumerate(names)], "holder string, h int")
    pairs = naming.containing(holders, "holder", held, "part")
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert sorted((r.holder, r.part, r.k, r.h) for r in pairs.collect()) == sorted((a, b, k, -h) for h, a in enumerate(names) for k, b in enumerate(names) if a and b and b in a)


def test_points_need_both_metrics_and_stars(spark):
    frames = spark.createDataFrame([("a", 2.0, 0.3, 5), ("b", None, 0.3, 5), ("c", 2.0, None, 5), ("d", 2.0, 0.3, 0)], "path string, fwhm double, ecc double, n int")
    assert [tuple(r) for r in signals.metric_points(frames, "path", "fwhm", "ecc", "n").collect()] == [("a", 2.0, 0.3)]
    assert signals.metric_points(frames, "path", "fwhm", "ecc").count() == 2
