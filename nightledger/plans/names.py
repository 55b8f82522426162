"""Registered queries over names, headers, file names and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers, naming, sky
from ..operators import listings
from .catalog import query

# Stand-ins: spellings that Spark and DuckDB make alike from the exposures' numbers.
_NAMES = "CASE event_id % 9 WHEN 0 THEN ' M ' || CAST(user_id AS STRING) WHEN 1 THEN 'ngc00' || CAST(user_id AS STRING) WHEN 2 THEN 'Sh2 ' || CAST(user_id AS STRING) WHEN 3 THEN 'Caldwell ' || CAST(user_id AS STRING) WHEN 4 THEN 'IC' || CAST(user_id AS STRING) || 'b' WHEN 5 THEN 'Messier ' || CAST(user_id AS STRING) WHEN 6 THEN 'barnard 0' || CAST(user_id AS STRING) WHEN 7 THEN NULL ELSE 'Veil ' || CAST(user_id AS STRING) END"
_ZERO = "CAST(CAST(regexp_extract(n, '([0-9]+)', 1) AS BIGINT) AS STRING)"


def _events(v, **columns: str):
    return v.events.selectExpr("event_id", *(f"{e} AS `{c}`" for c, e in columns.items()))


@query("B06_normalize_catalog_id", f"""WITH e AS (SELECT event_id, trim(coalesce({_NAMES}, '')) AS n FROM events) SELECT event_id, CASE WHEN n = '' THEN '' WHEN regexp_matches(n, '^M(essier)? *[0-9]') THEN 'M' || {_ZERO} WHEN n LIKE 'ngc%' THEN 'NGC ' || {_ZERO} WHEN n LIKE 'Sh2%' THEN 'Sh2-' || CAST(CAST(substr(n, 5) AS BIGINT) AS STRING)
 WHEN n LIKE 'Caldwell%' THEN 'Caldwell ' || {_ZERO} WHEN n LIKE 'IC%' THEN 'IC ' || {_ZERO} || 'b' WHEN n LIKE 'barnard%' THEN 'B ' || {_ZERO} ELSE n END AS name FROM e""")
def _(v):
    return _events(v, n=_NAMES).select("event_id", naming.normalize_catalog_id(F.col("n")).alias("name"))


_FILTERS = "CASE event_id % 10 WHEN 0 THEN 'lum' WHEN 1 THEN 'Astro H-alpha 5nm' WHEN 2 THEN 'O3' WHEN 3 THEN ' Red ' WHEN 4 THEN 'oiii' WHEN 5 THEN 'custom ' || CAST(user_id % 4 AS STRING) WHEN 6 THEN NULL WHEN 7 THEN '[SII] pro' WHEN 8 THEN 'G' ELSE 'H_ALPHA' END"
_CANONICAL = "CASE event_id % 10 WHEN 0 THEN 'L' WHEN 1 THEN 'Ha' WHEN 2 THEN 'OIII' WHEN 3 THEN 'R' WHEN 4 THEN 'OIII' WHEN 5 THEN 'custom ' || CAST(user_id % 4 AS STRING) WHEN 6 THEN '' WHEN 7 THEN 'SII' WHEN 8 THEN 'G' ELSE 'Ha' END"


def _canonical(v):
    return naming.normalize_by_aliases(_events(v, filter=_FILTERS, user_id="user_id"), "filter", naming.aliases_frame(v.spark), "canonical")


@query("B08_normalize_filter", f"SELECT event_id, {_CANONICAL} AS canonical FROM events")
def _(v):
    return _canonical(v).select("event_id", "canonical")


@query("D47_classify_filters", f"SELECT DISTINCT {_FILTERS} AS filter, {_CANONICAL} AS canonical FROM events")
def _(v):
    return _canonical(v).select("filter", "canonical").distinct()


@query("B32_palettes", f"""WITH s AS (SELECT user_id, list_distinct(list(c)) AS s FROM (SELECT user_id, {_CANONICAL} AS c FROM events) WHERE c <> '' GROUP BY user_id) SELECT user_id, CASE WHEN list_has_all(s, ['Ha', 'SII', 'OIII']) THEN 'SHO (Hubble)' WHEN list_has_all(s, ['Ha', 'OIII']) THEN 'HOO'
 WHEN list_has_all(s, ['L', 'R', 'G', 'B']) THEN 'LRGB' WHEN list_has_all(s, ['R', 'G', 'B']) THEN 'RGB' WHEN s = ['L'] THEN 'Mono L' WHEN s = ['Ha'] THEN 'Ha only' ELSE 'Mixed' END AS palette FROM s""")
def _(v):
    sets = _canonical(v).where("canonical <> ''").groupBy("user_id").agg(F.collect_set("canonical").alias("s"))  # a set of filter names
    return sets.select("user_id", naming.palette(F.col("s")).alias("palette"))


@query("B09_greek_to_ascii", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ha' || event_type WHEN 1 THEN 'thb ' || event_type WHEN 2 THEN 'OmPHps' ELSE 'plain' END AS name FROM events")
def _(v):
    return _events(v, n="CASE event_id % 4 WHEN 0 THEN ' Hα' || event_type WHEN 1 THEN 'θβ ' || event_type WHEN 2 THEN 'ΩmΦψ' ELSE 'plain ' END").select("event_id", naming.greek_to_ascii(F.col("n")).alias("name"))


_CAMERAS = "CASE event_id % 8 WHEN 0 THEN 'ZWO ASI2600MC Pro' WHEN 1 THEN 'QHY  268M' WHEN 2 THEN 'fli pl16803' WHEN 3 THEN 'Canon EOS R' || CAST(user_id % 3 AS STRING) WHEN 4 THEN 'ATIK one mono' WHEN 5 THEN NULL WHEN 6 THEN 'G3-16200' ELSE 'PLAYER ONE Poseidon-C ' END"


@query("B10_normalize_camera", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'ASI2600' WHEN 1 THEN 'QHY268' WHEN 2 THEN 'FLI PL16803' WHEN 3 THEN 'Canon EOS R' || CAST(user_id % 3 AS STRING) WHEN 4 THEN 'ATIK one mono' WHEN 5 THEN '' WHEN 6 THEN 'G3-16200' ELSE 'Poseidon' END AS camera FROM events""")
def _(v):
    mapping = v.spark.createDataFrame([("268M", "QHY268"), ("FLI PL16803", "FLI PL16803")], "alias string, canonical string")
    models = v.spark.createDataFrame([("ASI2600", 0), ("Poseidon", 1)], "model string, rank int")
    return naming.normalize_camera(_events(v, n=_CAMERAS), "n", mapping, models, "camera").select("event_id", "camera")


@query("B11_camera_kinds", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 3 THEN true WHEN 4 THEN false WHEN 7 THEN true END AS is_color, CASE event_id % 8 WHEN 1 THEN 'QHY' WHEN 4 THEN 'Atik' WHEN 5 THEN 'Other' WHEN 6 THEN 'Moravian' WHEN 7 THEN 'Player One' ELSE 'Other' END AS brand FROM events""")
def _(v):
    e = _events(v, n=_CAMERAS)
    return e.select("event_id", naming.is_color_camera(F.col("n")).alias("is_color"), naming.camera_brand(F.coalesce("n", F.lit(""))).alias("brand"))


@query("D46_cameras_by_brand", f"""WITH d AS (SELECT DISTINCT {_CAMERAS} AS n FROM events) SELECT CASE WHEN n LIKE 'QHY%' THEN 'QHY' WHEN n LIKE 'ATIK%' THEN 'Atik' WHEN n LIKE 'G3%' THEN 'Moravian' WHEN n LIKE 'PLAYER%' THEN 'Player One' ELSE 'Other' END AS brand, array_to_string(list_sort(list(n)), ';') AS cameras FROM d WHERE n IS NOT NULL GROUP BY brand""")
def _(v):
    names = _events(v, n=_CAMERAS).where("n is not null").select("n").distinct()  # the catalogue of models
    return names.groupBy(naming.camera_brand(F.col("n")).alias("brand")).agg(F.array_join(F.array_sort(F.collect_list("n")), ";").alias("cameras"))


_HEADER = {
    "TELESCOP": "CASE event_id % 5 WHEN 0 THEN '''OHP T120''' WHEN 1 THEN 'ACP-&gt;NTM' WHEN 2 THEN 'IRIS OHP' WHEN 3 THEN NULL ELSE 'RC10' END", "OBSERVAT": "CASE event_id % 5 WHEN 1 THEN 'IRiS' ELSE NULL END",
    "INSTRUME": "CASE event_id % 5 WHEN 0 THEN 'Andor Tech' WHEN 1 THEN 'flipro0:PL0394113' WHEN 2 THEN 'FLI' ELSE 'x' END", "APTDIA": "CASE event_id % 5 WHEN 3 THEN '1200.0' END", "FOCALLEN": "CASE event_id % 5 WHEN 3 THEN '7200' END",
    "XPIXSZ": "CASE event_id % 5 WHEN 0 THEN '27.0' WHEN 2 THEN '9.0' WHEN 3 THEN '21.911' END", "XBINNING": "CASE event_id % 5 WHEN 2 THEN '1' ELSE '2' END", "NAXIS1": "'1024'",
}


@query("B12_detect_observatory", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OHP T120' WHEN 1 THEN 'OHP IRIS' WHEN 2 THEN 'OHP IRIS' WHEN 3 THEN 'OHP T120' END AS telescope, CASE event_id % 5 WHEN 0 THEN 'Andor iKon-L 936' WHEN 1 THEN 'FLI ProLine 2048' WHEN 2 THEN 'FLI ProLine 4096' WHEN 3 THEN 'Andor Marana 4.2B-11' END AS camera,
 CAST(CASE event_id % 5 WHEN 2 THEN 1 WHEN 4 THEN NULL ELSE 2 END AS INT) AS binning, CASE event_id % 5 WHEN 0 THEN 0.77 WHEN 1 THEN 1.368 WHEN 2 THEN 0.456 WHEN 3 THEN 0.627 END AS image_scale_arcsec FROM events""", "image_scale_arcsec")
def _(v):
    found = headers.detect_observatory({k: F.col(k) for k in _HEADER})
    return _events(v, **_HEADER).select("event_id", *(found[c].alias(c) for c in ("telescope", "camera", "binning", "image_scale_arcsec")))


_PATHS = "CASE doc_id % 7 WHEN 0 THEN '/x/Calibrated/a.fits' WHEN 1 THEN '/x/a_DBE.xisf' WHEN 2 THEN '/x/MasterDark_1.xisf' WHEN 3 THEN '/x/process' ELSE '/x/' || source || '/light.fits' END"
_SOFTWARE = "CASE doc_id % 4 WHEN 0 THEN 'PixelWorks Core 1.9' WHEN 1 THEN NULL ELSE 'MaxIm DL' END"


@query("B15_processed", "SELECT doc_id, doc_id % 7 IN (0, 1, 2) AS by_path, doc_id % 4 = 0 AS by_header FROM documents")
def _(v):
    d = v.documents.selectExpr("doc_id", f"{_PATHS} AS p", f"{_SOFTWARE} AS s")
    return d.select("doc_id", naming.is_processed_path(F.col("p")).alias("by_path"), naming.is_processed_header(F.col("s"), ("pixelworks",)).alias("by_header"))


_CARDS = "o_orderkey AS path, CASE l WHEN 0 THEN 'EXPTIME' WHEN 1 THEN 'EXPOSURE' ELSE 'FILTER' END AS keyword"


@query("B16_resolve_headers", """WITH c AS (SELECT o_orderkey AS path, 'EXPOSURE' AS keyword, CAST(o_custkey AS STRING) AS value FROM orders UNION ALL SELECT o_orderkey, 'EXPTIME', o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'FILT', o_orderpriority FROM orders), r AS (SELECT path, CASE WHEN keyword LIKE 'EXP%' THEN 'EXPTIME' ELSE 'FILTER' END AS canonical, keyword, value, CASE keyword WHEN 'EXPOSURE' THEN 1 WHEN 'FILT' THEN 2 ELSE 0 END AS k FROM c)
 SELECT path, canonical, keyword, value FROM r QUALIFY row_number() OVER (PARTITION BY path, canonical ORDER BY k, value) = 1""")
def _(v):
    o = v.orders
    cards = o.selectExpr("o_orderkey AS path", "'EXPOSURE' AS keyword", "CAST(o_custkey AS STRING) AS value").unionByName(o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS path", "'EXPTIME' AS keyword", "o_orderstatus AS value")).unionByName(o.selectExpr("o_orderkey AS path", "'FILT' AS keyword", "o_orderpriority AS value"))
    aliases = v.spark.createDataFrame([("EXPTIME", "EXPTIME", 0), ("EXPOSURE", "EXPTIME", 1), ("FILTER", "FILTER", 0), ("FILT", "FILTER", 2)], "keyword string, canonical string, rank int")
    return headers.resolve_headers(cards, aliases)


@query("B17_coerce_headers", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS whole, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS number, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END AS flag, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE trim(o_orderpriority) END AS text FROM orders", "number")
def _(v):
    o = v.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' ' || CAST(o_totalprice AS STRING) END AS n", "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN ' yes' ELSE 'F' END AS b", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' ' || o_orderpriority || ' ' END AS t")
    return o.select("o_orderkey", headers.coerce_header(F.col("n"), "int").alias("whole"), headers.coerce_header(F.col("n"), "float").alias("number"), headers.coerce_header(F.col("b"), "bool").alias("flag"), headers.coerce_header(F.col("t"), "string").alias("text"))


@query("B18_to_sexagesimal", """WITH t AS (SELECT id, ra_deg, dec_deg, CAST(ra_deg AS DOUBLE) / 15 AS h, abs(CAST(dec_deg AS DOUBLE)) AS d FROM {targets}), u AS (SELECT *, CAST(floor(h) AS INT) AS hh, CAST(floor(d) AS INT) AS dd, CAST(floor((h - floor(h)) * 60) AS INT) AS hm, CAST(floor((d - floor(d)) * 60) AS INT) AS dm FROM t)
 SELECT id, printf('%02dh %02dm %05.2fs', hh, hm, (h - hh - hm / 60.0) * 3600) AS ra, printf('%s%02dd %02dm %04.1fs', CASE WHEN dec_deg >= 0 THEN '+' ELSE '-' END, dd, dm, (d - dd - dm / 60.0) * 3600) AS dec FROM u""")
def _(v):
    ra, dec = naming.degrees_to_sexagesimal(F.col("ra_deg"), F.col("dec_deg"))
    return v.targets.select("id", ra.alias("ra"), dec.alias("dec"))


_WCS = {"CRVAL1": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END", "CRVAL2": "l_tax", "CDELT1": "CASE WHEN l_linenumber % 2 = 0 THEN 0.0002 * l_linenumber END", "CDELT2": "CASE WHEN l_linenumber % 2 = 0 THEN -0.0003 END", "CD1_1": "0.0001 * l_linenumber", "CD1_2": "-0.0002", "CD2_1": "0.0002", "CD2_2": "0.0001", "NAXIS1": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 4000 END", "CRPIX1": "1500.0", "NAXIS2": "3000"}


@query("B21_wcs_info", f"""WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS path, {', '.join(f'{e} AS {k}' for k, e in _WCS.items())} FROM lineitem), s AS (SELECT *, CASE WHEN CDELT1 IS NOT NULL THEN (abs(CDELT1) + abs(CDELT2)) / 2 * 3600 ELSE (sqrt(CD1_1 ** 2 + CD2_1 ** 2) + sqrt(CD1_2 ** 2 + CD2_2 ** 2)) / 2 * 3600 END AS sc, coalesce(NAXIS1, 3000) AS w FROM h)
 SELECT path, CRVAL1 IS NOT NULL AS solved, CASE WHEN CRVAL1 IS NOT NULL THEN sc END AS scale, CASE WHEN CRVAL1 IS NOT NULL THEN degrees(atan2(CD2_1, CD1_1)) END AS rotation, CAST(CASE WHEN CRVAL1 IS NOT NULL THEN w END AS INT) AS width, CASE WHEN CRVAL1 IS NOT NULL THEN w * sc / 3600 END AS fov_x FROM s""", "scale rotation fov_x")
def _(v):
    found = headers.wcs_info({k: F.expr(e) for k, e in _WCS.items()})
    return v.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), *(found[c].alias(c) for c in ("solved", "scale", "rotation", "width", "fov_x")))


@query("B22_detect_reducer", """WITH m AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS path, 3.76 / (500 * (0.6 + l_discount * 5)) * 206.265 AS s FROM lineitem), r AS (SELECT rid, path, s / (3.76 / 500 * 206.265) AS ratio FROM m), k AS (SELECT rid, path, ratio, known, name, abs(ratio - known) AS gap FROM r, (VALUES (0.67, '0.67x Reducer'), (0.72, '0.72x Reducer'), (0.73, '0.73x Reducer (Starizona)'), (0.75, '0.75x Reducer'), (0.80, '0.80x Reducer'), (0.85, '0.85x Reducer'), (1.00, 'No Reducer (Native)')) v(known, name) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY gap, known) = 1)
 SELECT path, gap <= 0.03 AS detected, CASE WHEN gap <= 0.03 THEN name ELSE 'Unknown' END AS reducer_name, round(CASE WHEN gap <= 0.03 THEN 500 * known ELSE 500 END, 1) AS effective_focal_mm FROM k""", "effective_focal_mm")
def _(v):
    scale = F.lit(3.76) / (500 * (0.6 + F.col("l_discount") * 5)) * 206.265
    found = headers.detect_reducer(scale, F.lit(3.76), F.lit(500.0))
    return v.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), *(found[c].alias(c) for c in ("detected", "reducer_name", "effective_focal_mm")))


_SAFE = "left(trim(regexp_replace(regexp_replace(trim({c}), '[<>:\"/\\\\|?*'']', '_', 'g'), '\\s+', ' ', 'g'), '. '), 200)"


@query("B23_build_filename", """SELECT path, image_type || '_' || replace(target, ' ', ' ') || '_' || strftime(CAST(date_obs AS TIMESTAMP), '%Y-%m-%d_%H-%M-%S') || '_' || filter || '_' || binning || 'x' || binning || '_' || printf('%.2f', exposure) || 's_' || printf('%.2f', CAST(rotation AS DOUBLE)) || 'deg_' || CAST(CAST(round(temperature) AS INT) AS STRING) || '_' || telescope || '_' || camera || '_' || printf('%04d', CAST(row_number() OVER (PARTITION BY target, filter, telescope, image_type ORDER BY date_obs, path) AS INT)) || '.fits' AS name FROM {frames}""")
def _(v):
    return listings.rename_plan(v.frames, ".fits").select("path", F.col("name"))


@query("B24_expand_template", "SELECT path, CASE WHEN image_type IN ('DARK', 'BIAS') THEN camera || '/' || image_type || '/' || CAST(CAST(exposure AS INT) AS STRING) || '_' || CAST(CAST(temperature AS INT) AS STRING) ELSE target || '/' || image_type || '/' || filter END AS folder FROM {frames}")
def _(v):
    return v.frames.select("path", listings.folder_of().alias("folder"))


@query("B25_filter_by_time", """WITH m AS (SELECT event_id, CAST(extract(hour FROM ts + INTERVAL 40 MINUTE) AS INT) * 60 + CAST(extract(minute FROM ts + INTERVAL 40 MINUTE) AS INT) + floor(extract(second FROM ts + INTERVAL 40 MINUTE)) / 60 AS m FROM events)
 SELECT event_id, CASE WHEN m >= 1200 AND m < 1410 THEN 'Ha' WHEN m >= 1410 OR m < 180 THEN 'OIII' ELSE '' END AS filter FROM m""")
def _(v):
    return v.events.select("event_id", naming.filter_by_time(F.col("ts"), [("20:00", "23:30", "Ha"), ("05:00", "05:00", "none"), ("23:30", "03:00", "OIII")], longitude=10.0).alias("filter"))


@query("B31_fwhm_grades", "SELECT frame, star, CASE WHEN fwhm < 2 THEN 'Excellent' WHEN fwhm < 3 THEN 'Good' WHEN fwhm < 4 THEN 'Fair' ELSE 'Poor' END AS grade FROM {stars}")
def _(v):
    return v.stars.select("frame", "star", naming.fwhm_grade(F.col("fwhm"), (2.0, 3.0, 4.0)).alias("grade"))


_DESCRIPTIONS = "CASE p_partkey % 6 WHEN 0 THEN 'Barred Spiral' WHEN 1 THEN 'planetary nebula in ' || p_type WHEN 2 THEN 'Emission region' WHEN 3 THEN 'Open cluster' WHEN 4 THEN 'Comet ' || p_name ELSE 'star' END"


@query("B33_object_labels", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Galaxy' WHEN 1 THEN 'Planetary Nebula' WHEN 2 THEN 'Nebula' WHEN 3 THEN 'Cluster' WHEN 4 THEN 'Planet/Moon' ELSE 'Other' END AS object_type, CASE p_partkey % 5 WHEN 0 THEN 'NGC' WHEN 1 THEN 'Sharpless' WHEN 2 THEN 'Caldwell' WHEN 3 THEN 'Arp' ELSE 'Other' END AS catalogue FROM part""")
def _(v):
    p = v.part.selectExpr("p_partkey AS id", f"{_DESCRIPTIONS} AS d", "CASE p_partkey % 5 WHEN 0 THEN 'ngc 1' WHEN 1 THEN 'SH2-5' WHEN 2 THEN 'C 14' WHEN 3 THEN 'Arp 8' ELSE 'C x' END AS k")
    return p.select("id", naming.object_type(F.col("d")).alias("object_type"), naming.catalog_of(F.col("k")).alias("catalogue"))


@query("B34_format_size", "WITH s AS (SELECT file_id, CAST(length AS DOUBLE) * pow(40, file_id % 7) AS n FROM {files}) SELECT file_id, CASE WHEN n >= 1024.0 ** 4 THEN printf('%.2f TB', n / 1024.0 ** 4) WHEN n >= 1024.0 ** 3 THEN printf('%.2f GB', n / 1024.0 ** 3) WHEN n >= 1024.0 ** 2 THEN printf('%.1f MB', n / 1024.0 ** 2) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024) ELSE printf('%d B', CAST(n AS BIGINT)) END AS size FROM s")
def _(v):
    return v.files.select("file_id", naming.format_size(F.col("length").cast("double") * F.pow(F.lit(40.0), F.col("file_id") % 7)).alias("size"))


@query("B35_clean_equipment", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CFF RC10' WHEN 1 THEN 'FSQ85-EDP' WHEN 2 THEN 'A' || CAST(user_id AS STRING) || ', Zed' ELSE 'T1' END AS telescope, CASE event_id % 4 WHEN 0 THEN 'CFF RC10 + C' WHEN 1 THEN 'FSQ85-EDP + C' WHEN 2 THEN 'A' || CAST(user_id AS STRING) || ', Zed' ELSE 'T1 + C' END AS setup FROM events""")
def _(v):
    e = _events(v, t="CASE event_id % 4 WHEN 0 THEN 'RC10, CFF RC10' WHEN 1 THEN '[''FSQ85-EDP'']' WHEN 2 THEN 'Zed,A' || CAST(user_id AS STRING) ELSE 'T1' END", c="CASE event_id % 4 WHEN 2 THEN '' ELSE 'C' END").withColumn("telescope", naming.clean_equipment(F.col("t")))
    return e.select("event_id", "telescope", naming.setup_of(F.col("telescope"), F.col("c")).alias("setup"))


@query("B36_repair_filters", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HA' WHEN 1 THEN 'HA' WHEN 2 THEN 'OIII' WHEN 3 THEN 'R' WHEN 4 THEN 'OIII' ELSE 'SII' END AS filter FROM events")
def _(v):
    return naming.repair_filters(_events(v, f="CASE event_id % 6 WHEN 0 THEN 'H?' WHEN 1 THEN 'Hα' WHEN 2 THEN 'O' WHEN 3 THEN 'R' WHEN 4 THEN 'OIII' ELSE 'SII' END"), "f", "filter").select("event_id", "filter")


@query("B37_decode_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events""")
def _(v):
    e = _events(v, j="CASE WHEN event_id % 3 = 0 THEN '{broken' ELSE '{\"kind\": \"' || event_type || '\", \"user\": ' || CAST(user_id AS STRING) || '}' END").withColumn("d", naming.decode_json(F.col("j"), "kind string, user long"))
    return e.select("event_id", F.col("d.kind").alias("kind"), F.col("d.user").alias("user_id"))


@query("B40_normalize_ra", "SELECT id, CASE WHEN ra_deg >= 24 THEN ra_deg / 15 ELSE ra_deg END AS ra_hours FROM {targets} WHERE dec_deg BETWEEN -90 AND 90", "ra_hours")
def _(v):
    ra = naming.normalize_ra(F.col("ra_deg"))
    return v.targets.where(naming.valid_position(ra, F.col("dec_deg"))).select("id", ra.alias("ra_hours"))


@query("B38_exposures_where", "SELECT event_id, session_date, target_name, filter_name FROM {exposures} WHERE target_name = 'NGC 7' AND filter_name = 'view'")
def _(v):
    return listings.exposures_where(v.exposures, target_name="NGC 7", filter_name="view", session_date=None).select("event_id", "session_date", "target_name", "filter_name")


@query("B39_search_dimension", "SELECT telescope, focal_length, pixel_size FROM {equipment} WHERE lower(telescope) LIKE '%t1%' AND pixel_size >= 4 AND pixel_size < 5 ORDER BY telescope LIMIT 500", "pixel_size")
def _(v):
    return listings.search_dimension(v.equipment, "T1", ["telescope"], ranges={"pixel_size": (4.0, 5.0)}, order=["telescope"], most=500).select("telescope", "focal_length", "pixel_size")


@query("B43_listing", "SELECT target_id, observation_date, filter, seq FROM {observations} WHERE target_id = 17")
def _(v):
    return listings.listing(v.observations, {"target_id": 17}, ["observation_date", "seq"]).select("target_id", "observation_date", "filter", "seq")


@query("B42_storage_savings", """WITH f AS (SELECT *, CASE WHEN path LIKE '%.fits' THEN 'fits' WHEN path LIKE '%.xisf' THEN 'xisf' END AS format, DATE '2024-01-01' - CAST(file_id % 400 AS INT) AS modified FROM {files})
 SELECT 'compress' AS kind, count(*) AS n, CAST(sum(length) AS BIGINT) AS size, CAST(floor(sum(length) * 0.5) AS BIGINT) AS savings FROM f WHERE format = 'fits' UNION ALL SELECT 'recompress', count(*), CAST(sum(length) AS BIGINT), CAST(floor(sum(length) * 0.15) AS BIGINT) FROM f WHERE format = 'xisf' UNION ALL SELECT 'archive', count(*), CAST(sum(length) AS BIGINT), CAST(NULL AS BIGINT) FROM f WHERE source = 'web' AND modified < DATE '2024-01-01' - 180""")
def _(v):
    files = v.files.withColumn("modified", F.expr("date_sub(DATE '2024-01-01', CAST(file_id % 400 AS INT))")).withColumn("is_calibration", F.col("source") == "web")
    return listings.storage_savings(files, "2024-01-01")


@query("B30_quality_scores", """SELECT frame, star, greatest(0, least(100, 0.35 * greatest(0, least(100, (fwhm - 8) / -6 * 100)) + 0.2 * greatest(0, least(100, (eccentricity - 0.8) / -0.5 * 100)) + 0.2 * CASE WHEN frame % 3 = 0 THEN 0 ELSE greatest(0, least(100, (snr - 5) / 45 * 100)) END + 0.15 * 100 + 0.1 * 50)) AS score FROM {stars}""", "score")
def _(v):
    score = sky.quality_score({"fwhm": F.col("fwhm"), "eccentricity": F.col("eccentricity"), "snr": F.when(F.col("frame") % 3 != 0, F.col("snr")), "stars": F.lit(100.0), "roundness": F.lit(0.55)})
    return v.stars.select("frame", "star", score.alias("score"))
