import math

import pytest
from pyspark.sql import functions as F

from nightledger.functions import headers, naming, sky, text
from nightledger.operators import calibration, joins, listings, signals, stats

# Expected values of an observatory's headers.
FRAMES = [
    ({"TELESCOP": "'OHP T120'", "INSTRUME": "'Andor Tech'", "APTDIA": "1200.0", "FOCALLEN": "7200.0", "XPIXSZ": "27.0", "XBINNING": "2", "NAXIS1": "1024"}, ("OHP T120", "Andor iKon-L 936", 2, 0.770)),
    ({"TELESCOP": "'OHP T120'", "INSTRUME": "'Andor Tech'", "XPIXSZ": "13.5", "XBINNING": "1", "NAXIS1": "2048"}, ("OHP T120", "Andor iKon-L 936", 1, 0.385)),
    ({"TELESCOP": "OHP T120", "INSTRUME": "Andor sCMOS (SDK3)", "XBINNING": "2", "NAXIS1": "1024"}, ("OHP T120", "Andor Marana 4.2B-11", 2, 0.627)),
    ({"TELESCOP": "'IRIS OHP'", "INSTRUME": "'flipro0:PL0394113'", "OBSERVAT": "'IRiS'", "XPIXSZ": "13.5", "XBINNING": "1"}, ("OHP IRIS", "FLI ProLine 2048", 1, 0.684)),
    ({"TELESCOP": "'ACP-&gt;NTM'", "INSTRUME": "'flipro0:PL1344016'", "OBSERVAT": "'IRiS'", "XPIXSZ": "9.0", "XBINNING": "1"}, ("OHP IRIS", "FLI ProLine 4096", 1, 0.456)),
    ({"TELESCOP": "'IRIS OHP'", "INSTRUME": "'FLI'", "XPIXSZ": "9.0", "XBINNING": "1", "NAXIS1": "4096"}, ("OHP IRIS", "FLI ProLine 4096", 1, 0.456)),
    ({"INSTRUME": "x", "APTDIA": "1199", "FOCALLEN": "7200", "XPIXSZ": "22", "XBINNING": "2"}, ("OHP T120", "Andor Marana 4.2B-11", 2, 0.627)),
    ({"TELESCOP": "ACP->NTM", "INSTRUME": "FLI"}, (None, None, None, None)),
    ({"TELESCOP": "RC10", "INSTRUME": "PL0394113"}, (None, None, None, None)),
]
KEYS = ("TELESCOP", "OBSERVAT", "INSTRUME", "APTDIA", "FOCALLEN", "XPIXSZ", "XBINNING", "NAXIS1")


def test_observatories(spark):
    rows = spark.createDataFrame([(i, *(h.get(k) for k in KEYS)) for i, (h, _) in enumerate(FRAMES)], "i int, " + ", ".join(f"{k} string" for k in KEYS))
    found = headers.detect_observatory({k: F.col(k) for k in KEYS})
    got = rows.select("i", *(found[c].alias(c) for c in ("telescope", "camera", "binning", "image_scale_arcsec"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [want for _, want in FRAMES]


def test_an_unknown_measure_counts_nothing(spark):
    row = spark.createDataFrame([(None, 0.3, 50.0)], "fwhm double, eccentricity double, snr double").select(sky.quality_score({"fwhm": F.col("fwhm"), "eccentricity": F.col("eccentricity"), "snr": F.col("snr"), "stars": F.lit(100), "roundness": F.lit(0.8)}).alias("s")).first()
    assert math.isclose(row.s, 65.0)


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e6, 0.05), (0.0, 5, 1.0), (4.0, 30, 0.000382)])
def test_p_values(spark, t, df, p):
    got = spark.range(1).select(signals.two_sided_p(F.lit(float(t)), F.lit(float(df))).alias("p")).first().p
    assert abs(got - p) < 2e-5


def test_t_quantiles(spark):
    for df, want in ((9, 2.262157), (30, 2.042272), (1000, 1.962339)):
        assert abs(spark.range(1).select(signals.t_quantile_95(F.lit(float(df))).alias("q")).first().q - want) < 3e-4


def test_medians_of_counts(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0)] + [("b", 5.0), ("b", None)] + [("c", x) for x in (1.0, 3.0, 7.0)], "k string, v double")
    assert {r.k: r.m for r in stats.medians(rows, ["k"], "v", "m").collect()} == {"a": 2.0, "b": 5.0, "c": 3.0}


def test_flats_of_lights_with_unknown_attributes(spark):
    columns = "path long, image_type string, date_obs timestamp, telescope string, camera string, filter string, binning int, rotation int, temperature double"
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d, 20)
    flats = [(1, "FLAT", day(1), "T", "C", "L", 1, 0, 1.0), (2, "FLAT", day(5), "T", "C", "R", 1, 0, 1.0), (3, "FLAT", None, "T", "D", "L", 1, 0, 1.0), (4, "FLAT", day(2), "T", "C", "L", 2, 0, 1.0)]
    lights = [(10, "LIGHT", day(2), None, "C", "L", 1, 0, 1.0), (11, "LIGHT", day(2), "T", " ", None, 1, 0, 1.0), (12, "LIGHT", None, "T", "C", "R", 1, 0, 1.0), (13, "LIGHT", day(2), "X", "C", "L", 1, 0, 1.0)]
    groups = calibration.flat_groups(spark.createDataFrame(flats, columns))
    found = calibration.match_flats(spark.createDataFrame(lights, columns), groups).collect()
    got = sorted((r.telescope or "", r.camera or "", r.filter or "", r.flat_camera, r.flat_filter, r.days, r.rank) for r in found if (r.night is not None))
    assert got == [("", "C", "L", "C", "L", 1, 1), ("T", "", "", "C", "L", 1, 1), ("T", "", "", "C", "R", 3, 2), ("T", "", "", "D", "L", None, 3)]
    assert [(r.flat_filter, r.days) for r in found if r.night is None] == [("R", None)]


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.target_from_path(F.lit("/a/b/c/d/e/LIGHT/x"))) == "e" and one(text.target_from_path(F.lit("/M 1/Night_1/Night_2/Night_3/LIGHT/x"))) is None
    assert one(naming.sanitize(F.lit(" a/b:c  d. "))) == "a_b_c d" and one(naming.format_size(F.lit(1536.0))) in ("2 KB", "1 KB")
    assert one(naming.clean_equipment(F.lit("FLI, FLI PL16803, Other"))) == "FLI PL16803, Other"


def test_image_files_under_a_folder(spark, tmp_path):
    for name in ("a/light.fits", "a/Darks/d.fit", "a/masterDark.xisf", "a/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda **k: sorted(r.path.rsplit("/", 1)[1] for r in listings.list_image_files(spark, str(tmp_path), **k).collect())
    assert names() == ["d.fit", "light.fits"] and names(skip_calibration=True) == ["light.fits"] and names(skip_processed=False) == ["d.fit", "light.fits", "masterDark.xisf"]


def test_radius_search(spark):
    rows = spark.createDataFrame([(1, 0.0, 89.9), (2, 180.0, 89.9), (3, 10.0, 0.0)], "id long, ra_deg double, dec_deg double")
    assert {r.id for r in joins.within_radius(rows, 90.0, 90.0, 0.2).collect()} == {1, 2}
