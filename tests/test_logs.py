import struct

from nightledger.operators import processing
from nightledger.sources import history, logs
from tests.test_sources import write

LOG = """[2024-01-02 03:04:05] Tool Core 1.9.3 Lockhart (x64)
Weighted Batch Preprocessing Script 2.8.9
about the Product
Group of 30 Light frames (28 active)
SIZE  : 4144x2822
BINNING  : 1
Filter   : Ha
Exposure : 300.00s
Keywords : [NIGHT: 1]
Master dark: /m/dark.xisf
Master flat: none
***
Group of 12 Flat frames (12 active)
Exposure : [1.0s, 2.0s]

[Frames rejection] a_1.xisf - 0.51 > 0.20 | accepted
[Frames rejection] a-2.xisf - 0.11 < 0.20 | rejected
*** Warning: frame rejected [a_3.xisf - 0.05
=== StarAlignment: 20 succeeded, 3 failed, 1 skipped
=== StarAlignment: 5 succeeded, 0 failed, 0 skipped
* Begin integration of Light frames
Filter   : Ha
Group of 30 Light frames (28 active)

Integration of 26 images:
Pixel combination ......... Average
Weighting mode ............ PSF Signal Weight
Output normalization ...... Additive
Pixel rejection ........... Winsorized

Normalized image weights:
[  1] /r/a_1.xisf
0.95
[  2] /r/a_4.xisf
0.75
Integration of 26 images done
Pixel rejection counts:
/r/a_1.xisf
    1 :   120   1.25% (   20 +   100 =  0.25% +  1.00%)
Total :   500   2.50% (  100 +   400 =  0.50% +  2.00%)
SNR estimates : 3.5e+01
Noise estimates : 1.2e-04
* Writing master Light frame:
/m/light.xisf
* End integration of Light frames
* WeightedBatchPreprocessing: 01:02:03
"""


def test_processing_log_sections(spark, tmp_path):
    write(tmp_path / "a.log", LOG)
    lines = logs.read_processing_log(spark, str(tmp_path), "Product")
    light, flat = logs.calibration_groups(lines).where("line_no < 14").orderBy("line_no").collect()
    assert (light.n_frames, light.n_active, light.width, light.height, light.binning, light.filter_name, light.exposure_seconds, light.keywords, light.master_dark, light.master_flat, light.master_bias) == (30, 28, 4144, 2822, 1, "Ha", 300.0, "NIGHT: 1", "/m/dark.xisf", None, None)
    assert (flat.frame_type, flat.exposure_seconds, flat.exposure_range, flat.filter_name) == ("Flat", None, "1.0s, 2.0s", None)
    assert sorted((r.filename, r.weight, r.threshold, r.accepted) for r in logs.frame_rejections(lines).collect()) == [("a-2.xisf", 0.11, 0.2, False), ("a_1.xisf", 0.51, 0.2, True), ("a_3.xisf", 0.05, None, False)]
    (i,) = logs.integrations(lines).collect()
    assert (i.filter_name, i.frames_total, i.frames_integrated, i.frames_rejected, i.combination_method, i.weight_mode, i.normalization, i.rejection_method) == ("Ha", 30, 26, 4, "Average", "PSF Signal Weight", "Additive", "Winsorized")
    assert (i.total_rejection_pct, i.low_rejection_pct, i.high_rejection_pct, i.output_snr, i.output_noise, i.output_psf_signal, i.output_file) == (2.5, 0.5, 2.0, 35.0, 1.2e-4, None, "/m/light.xisf")
    assert [(r.filename, r.normalized_weight) for r in logs.integration_weights(lines).orderBy("line_no").collect()] == [("/r/a_1.xisf", 0.95), ("/r/a_4.xisf", 0.75)]
    assert [(r.filename, r.pixel_rejection_count, r.pixel_rejection_pct, r.low_rejection_pct, r.high_rejection_pct) for r in logs.pixel_rejections(lines).collect()] == [("/r/a_1.xisf", 120, 1.25, 0.25, 1.0)]
    (s,) = logs.log_summary(lines).collect()
    assert (str(s.log_timestamp), s.tool_version, s.script_name, s.script_version, s.registration_succeeded, s.registration_failed, s.registration_skipped, s.total_elapsed) == ("2024-01-02 03:04:05", "1.9.3 Lockhart", "Weighted Batch Preprocessing Script", "2.8.9", 25, 3, 1, "01:02:03")
    names = logs.integration_weights(lines).withColumn("integration_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    other = logs.pixel_rejections(lines).selectExpr("1 AS integration_id", "'/other/a_1.xisf' AS filename", "pixel_rejection_count")
    assert {r.filename: r.pixel_rejection_count for r in processing.attach_by_basename(names, other, ["pixel_rejection_count"]).collect()} == {"/r/a_1.xisf": 120, "/r/a_4.xisf": None}


def test_mount_companions(spark, tmp_path):
    write(tmp_path / "d/M_1.dat", "Monitor (v.1.25)\nLocation:\tHill\nMount:\t\nMount ID:\tx\nFirmware:\t2.0\nRAW Mount time\tx\n")
    write(tmp_path / "d/M_1.dti", "head\nMount time\tx\n10:00\t1\t2\t3\t4\n10:01\t1\t2\t3\t\n")
    write(tmp_path / "d/M_1.fft", "Timestamp\tx\n" + "\t".join(["t", "RA", "10", "64", *map(str, range(9))]) + "\nshort\tline\n")
    write(tmp_path / "d/M_1.env", "Timestamp\tx\nt1\t5.5\t\t7\tx\tsidereal\t\twest\t8.0\t1.5\t\nt2\t\n")
    write(tmp_path / "d/M_1.log", "start\nMount: Big One | FW: 3.1.2 | Protocol: a\nMount: Later | FW: 9\n")
    write(tmp_path / "e/M_1.dat", "Monitor\nRAW Mount time\tx\n")
    root = str(tmp_path)
    fft, env = logs.read_mount_fft(spark, root).collect(), logs.read_mount_env(spark, root).orderBy("line_no").collect()
    assert [(r.axis, r.sample_rate, r.num_bins, r.peak1_freq, r.peak3_amp) for r in fft] == [("RA", 10.0, 64, 0.0, 8.0)]
    assert (env[0].temp_ext, env[0].pressure, env[0].temp_int, env[0].tracking_rate, env[0].pier_side, env[0].align_stars, env[0].polar_error) == (5.5, None, 7.0, "sidereal", "west", 8, None) and len(env) == 2
    found = logs.mount_sessions(logs.read_mount_header(spark, root), ("dti", logs.read_mount_dti(spark, root)), ("fft", logs.read_mount_fft(spark, root)), ("env", logs.read_mount_env(spark, root)), ("log", logs.read_mount_meta(spark, root))).collect()
    got = {r.session[-5:]: (r.version, r.location, r.mount, r.firmware, r.n_dti, r.n_fft, r.n_env) for r in found}
    assert got == {"d/M_1": ("1.25", "Hill", "Big One", "2.0", 2, 1, 2), "e/M_1": (None, None, None, None, 0, 0, 0)}


def test_xisf_headers_and_wrong_endings(spark, tmp_path):
    xml = '<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="http://example.org/xisf"><Image geometry="1:1:1" compression="zlib:8"><FITSKeyword name="OBJECT" value="\'M 31    \'" comment="x"/><FITSKeyword name="EXPTIME" value="300." comment=""/></Image></xisf>'.encode()
    write(tmp_path / "a.xisf", b"XISF0100" + struct.pack("<I", len(xml)) + bytes(4) + xml + bytes(range(256)))
    write(tmp_path / "b.xisf", b"SIMPLE  =                    T")
    write(tmp_path / "c.fits", b"SIMPLE  =                    T")
    found = {(r.keyword, r.value, r.compression) for r in logs.read_xisf_headers(spark, str(tmp_path)).collect()}
    assert found == {("OBJECT", "M 31", "zlib:8"), ("EXPTIME", "300.", "zlib:8")}
    assert [(r.path[-6:], r.content) for r in logs.extension_mismatches(spark, str(tmp_path)).collect()] == [("b.xisf", "fits")]


def test_histories_round_trip(spark, tmp_path):
    targets = spark.createDataFrame([(1, "M 31", "M 31", "Galaxy", 10.5, 41.0), (2, "Alone", None, None, None, None)], "id long, name string, canonical_name string, object_type string, ra double, dec double")
    seen = spark.createDataFrame([(1, "2024-01-03", "L", 60.0, 3), (1, "2024-01-02", 'R "x", y', 30.0, 1)], "target_id long, observation_date string, filter string, exposure_time double, frame_count int")
    history.write_history_json(targets, seen, f"{tmp_path}/json")
    lines = [line for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    write(tmp_path / "whole.json", '{"version": "1.0", "targets": [' + ",".join(lines) + "]}")
    back, rows = history.read_history_json(spark, f"{tmp_path}/whole.json")
    assert sorted((r.name, r.ra) for r in back.collect()) == [("Alone", None), ("M 31", 10.5)]
    assert [(r.observation_date, r.filter, r.frame_count) for r in rows.orderBy("observation_date").collect()] == [("2024-01-02", 'R "x", y', 1), ("2024-01-03", "L", 3)]
    history.write_observations_csv(targets, seen, f"{tmp_path}/csv")
    write(tmp_path / "csv/bad.csv", "target_name,ra,dec\nBad,abc,1\n,1,2\nFine,1.5,\n")
    good, rejected = history.read_observations_csv(spark, f"{tmp_path}/csv/bad.csv")
    assert [(r.target_name, r.ra, r.dec) for r in good.collect()] == [("Fine", 1.5, None)] and [(r.target_name, r.reason) for r in rejected.collect()] == [("Bad", "invalid ra")]
    whole, _ = history.read_observations_csv(spark, f"{tmp_path}/csv/part-*.csv")
    assert sorted((r.target_name, r.filter, r.exposure_time) for r in whole.collect()) == [("M 31", "L", 60.0), ("M 31", 'R "x", y', 30.0)]


def test_dimension_has_one_row_a_key(spark, tmp_path):
    write(tmp_path / "cameras.csv", "camera,pixel\nA,3.76\nB,4\nA,9\n")
    assert sorted((r.camera, r.pixel) for r in history.load_dimension(spark, f"{tmp_path}/cameras.csv", "camera").collect()) == [("A", 3.76), ("B", 4.0)]
