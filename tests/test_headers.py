import os
import struct

from nightledger.sources import headers, logs


def fits(cards):
    body = "".join(c.ljust(80) for c in [*cards, "END"])
    return body.ljust(-(-len(body) // 2880) * 2880).encode()


def sparse(path, start, size):
    with open(path, "wb") as f:
        f.write(start)
        f.truncate(size)


def test_bytes_read_are_bounded_by_the_header(spark, tmp_path):
    plain = fits(["SIMPLE  =                    T", "NAXIS   =                    2", "OBJECT  = 'M 31    '", *["HISTORY x"] * 100])
    sparse(tmp_path / "a.fits", plain, 200 << 20)
    xml = b'<xisf><Image><FITSKeyword name="OBJECT" value="M 1"/></Image></xisf>'
    sparse(tmp_path / "b.xisf", b"XISF0100" + struct.pack("<I", len(xml)) + bytes(4) + xml, 200 << 20)
    of = lambda kind, pattern: headers.read_image_headers(spark, str(tmp_path), kind, pattern).collect()
    assert [(r.length, r.bytes_read) for r in of("fits", "*.fits")] == [(200 << 20, len(plain))]
    assert [(r.length, r.bytes_read) for r in of("xisf", "*.xisf")] == [(200 << 20, 16 + len(xml))]
    assert sorted((r.bytes_read, r.magic[:4]) for r in of("magic", "*")) == [(8, b"SIMP"), (8, b"XISF")]
    assert {r.keyword: r.value for r in logs.read_fits_headers(spark, str(tmp_path)).collect()} == {"SIMPLE": "T", "NAXIS": "2", "OBJECT": "M 31"}
    assert {r.keyword: r.value for r in logs.read_xisf_headers(spark, str(tmp_path)).collect()} == {"OBJECT": "M 1"}


def test_a_compressed_file_shows_its_own_header(spark, tmp_path):
    first = fits(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0 / no data", "ORIGIN  = 'tool'"])
    second = fits(["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "ZIMAGE  =                    T", *[f"KEY{k:<5}= {k}" for k in range(90)], "OBJECT  = 'It''s'", "EXPTIME =                300.0"])
    sparse(tmp_path / "c.fits.fz", first + second, 64 << 20)
    rows = logs.read_fits_headers(spark, str(tmp_path)).orderBy("place").collect()
    found = {r.keyword: r.value for r in rows}
    assert found["OBJECT"] == "It''s" and found["EXPTIME"] == "300.0" and found["NAXIS"] == "2" and found["ORIGIN"] == "tool" and found["SIMPLE"] == "T" and found["KEY89"] == "89"
    assert len(rows) == len(found) and [r.place for r in rows] == list(range(len(rows)))
    read = headers.read_image_headers(spark, str(tmp_path), "fits", "*.fz").first()
    assert read.bytes_read == len(first) + len(second) and len(read.headers) == 2


def test_files_that_have_no_header(spark, tmp_path):
    for name, body in (("empty.fits", b""), ("cut.fits", b"SIMPLE  = T".ljust(2000)), ("noend.fits", b"SIMPLE  = T".ljust(5760)), ("empty.xisf", b""), ("odd.xisf", b"XISF0100\xff\xff\xff\xff")):
        (tmp_path / name).write_bytes(body)
    assert logs.read_fits_headers(spark, str(tmp_path)).count() == 0 and logs.read_xisf_headers(spark, str(tmp_path)).count() == 0
    assert {os.path.basename(r.path) for r in logs.extension_mismatches(spark, str(tmp_path)).collect()} == {"empty.fits", "empty.xisf"}


def test_partitions_are_planned_over_files(spark, tmp_path):
    for k in range(10):
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"{k}.fit").write_bytes(fits([f"NUMBER  = {k}"]))
    (tmp_path / "d0" / "_temporary.fit").write_bytes(b"")
    spark.dataSource.register(headers.HeaderSource)
    rows = spark.read.format("image_headers").option("kind", "fits").option("pattern", "*.{fit,fits}").option("filesPerPartition", 3).load(f"file:{tmp_path}")
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 10
    assert sorted(int(r.value) for r in logs.read_fits_headers(spark, str(tmp_path)).collect()) == list(range(10))
    assert headers.expanded("*.{a,b}{1,2}") == ["*.a1", "*.a2", "*.b1", "*.b2"]
    assert headers.read_image_headers(spark, str(tmp_path), "fits", "*.none").count() == 0
