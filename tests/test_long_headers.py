from nightledger.sources import exposures, logs


def test_fits_header_beyond_the_first_piece(spark, tmp_path):
    cards = ["OBJECT  = 'M 31    '", *["HISTORY processed"] * 800, "EXPTIME =                300.0", "END"]
    body = "".join(c.ljust(80) for c in cards)
    (tmp_path / "a.fits").write_bytes(body.ljust(-(-len(body) // 2880) * 2880).encode() + bytes(range(256)) * 40)
    found = {r.keyword: r.value for r in logs.read_fits_headers(spark, str(tmp_path)).collect()}
    assert found == {"OBJECT": "M 31", "EXPTIME": "300.0"}


def test_csv_headers_beyond_64_columns(spark, tmp_path):
    other = [f"x{k}" for k in range(90)]
    (tmp_path / "aImageMetaData.csv").write_text(",".join(["Date", *other, "HFR"]) + "\n" + ",".join(["2024-01-02 13:00:00", *["1"] * 90, "2.5"]) + "\n")
    (tmp_path / "bImageMetaData.csv").write_text("HFR,Date\n1.5,2024-01-02 14:00:00\n")
    assert sorted(r.hfr for r in exposures.read_exposure_csv(spark, str(tmp_path)).collect()) == [1.5, 2.5]
