from nightledger.sources import exposures, logs


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)


def test_csv_files_of_different_layouts(spark, tmp_path):
    write(tmp_path / "M42/Night_1/LIGHT/ImageMetaData.csv", "﻿ExposureStartUTC,Filter Name,Duration,HFR,DetectedStars,FilePath\n2024-01-02T01:00:00,Ha,300,2.5,120,\"a,b.fits\"\n\n2024-01-02 01:10:00,Ha,300,NaN,12.5,c.fits\nnever,Ha,1,1,1,d\n")
    write(tmp_path / "M42/Night_1/LIGHT/WeatherData.csv", "Date,Temperature,Humidity\n2024-01-02 01:00:20,4.5,70\n2024-01-02 01:11:00,5,N/A\n")
    write(tmp_path / "other/ImageMetaData.csv", "Target,HFR,Date,exposure\nngc0224,1.5,2024-01-02 13:00:00,60\n")
    found = {r.file_path or "other": r for r in exposures.scan_sessions(spark, str(tmp_path)).collect()}
    assert set(found) == {"a,b.fits", "c.fits", "other"}
    first, second, third = found["a,b.fits"], found["c.fits"], found["other"]
    assert (first.target_name, first.filter_name, first.exposure_seconds, first.hfr, first.detected_stars) == ("M 42", "Ha", 300.0, 2.5, 120)
    assert (first.weather_temperature, first.weather_humidity, first.gap_seconds) == (4.5, 70.0, 20.0) and str(first.session_date) == "2024-01-01"
    assert second.hfr is None and second.detected_stars == 12 and second.weather_temperature is None
    assert (third.target_name, third.hfr, str(third.session_date)) == ("NGC 224", 1.5, "2024-01-02")


def test_mount_logs(spark, tmp_path):
    write(tmp_path / "s.dat", "Monitor (v.1.2)\nLocation: x\nRAW Mount time\tx\n" + "\t".join("0 10:00:01 2 5:30:00 0.5 5 -10:30:36 0.25 1.5 9 10 11 2.5 TRACKING".split(" ")) + "\nbad\tline\n")
    r = logs.read_mount_dat(spark, str(tmp_path)).collect()
    assert [(x.timestamp, x.ra_hours, x.ra_stdev, round(x.dec_degrees, 6), x.dec_stdev, x.dec_axis, x.ra_axis, x.status) for x in r] == [("10:00:01", 5.5, 0.5, -10.51, 0.25, 1.5, 2.5, "TRACKING")]


def test_processing_log(spark, tmp_path):
    text = "[2024-01-02 03:04:05] Tool Product 1.8\n[2024-01-02 03:04:06] frame_1.xisf\n------\nFWHM : 2.5\nSNR   : 12\n------\nGroup of 12 Light frames (10 active)\n"
    write(tmp_path / "a.log", text)
    write(tmp_path / "b.log", "something else")
    lines = logs.read_processing_log(spark, str(tmp_path), "Product")
    assert lines.where("logged_at is not null").count() == 2
    assert sorted((r.file, r.key, r.value) for r in logs.subframe_metrics(lines).collect()) == [("frame_1.xisf", "FWHM", "2.5"), ("frame_1.xisf", "SNR", "12")]
    assert [(r.n_frames, r.frame_type, r.n_active) for r in logs.calibration_groups(lines).collect()] == [(12, "Light", 10)]


def test_light_names_and_fits_headers(spark, tmp_path):
    names = spark.createDataFrame([("LIGHT_M 31_2024-01-02_03-04-05_Ha_1x1_300.00s_12.5_-10.0_CAM_0007.fits",), ("x.fits",)], "name string")
    first, second = logs.parse_light_filename(names, "name").collect()
    assert (first.target, first.filter, first.exposure, first.temperature, first.camera, first.sequence) == ("M 31", "Ha", 300.0, -10.0, "CAM", 7) and second.target is None
    cards = ["SIMPLE  =                    T / conforms", "OBJECT  = 'M 31    '           / target", "EXPTIME =                300.0", "COMMENT free text", "END"]
    write(tmp_path / "a.fits", "".join(c.ljust(80) for c in cards).ljust(2880).encode() + b"\x00" * 100)
    found = {r.keyword: r.value for r in logs.read_fits_headers(spark, str(tmp_path)).collect()}
    assert found == {"SIMPLE": "T", "OBJECT": "M 31", "EXPTIME": "300.0"}
