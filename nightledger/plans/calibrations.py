"""Registered queries of the calibration family: matches by profile, fallbacks, groups, flats and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration
from .catalog import query

_TEMP = {"instrument": "lower(trim(camera))", "binning": "binning", "gain": "gain", "offset": "bias_offset", "exposure": "exposure", "focal_length": "focal_length", "filter": "lower(trim(filter))", "temperature": "temperature"}
_COLUMNS = ", ".join(f"{e} AS p_{n}" for n, e in _TEMP.items())


def _frames(v, kind: str):
    return v.frames.where(f"image_type = '{kind}'").select("path", F.col("camera").alias("instrument"), "binning", "gain", F.col("bias_offset").alias("offset"), "exposure", "focal_length", "filter", "temperature")


def _scored(profile: str, lights: str, masters: str, k: int) -> str:
    """SQL that compares every light with every master by the rules, as (light, master, score, n_warnings, rank)."""
    agree, cost, warned = [], ["0"], ["0"]
    for n, (mode, tolerance, weight) in calibration.PROFILES[profile].items():
        a, b = f"l.p_{n}", f"m.p_{n}"
        same = f"({a} IS NOT DISTINCT FROM {b}" + (f" OR coalesce(abs({a} - {b}) <= {tolerance}, false))" if tolerance else ")")
        if mode == "exact":
            agree.append(same)
        else:
            cost.append(f"CASE WHEN {same} THEN 0 ELSE {weight} * (1 - greatest(0, 1 - abs(coalesce({a}, 0) - coalesce({b}, 0)) / {calibration.SPANS[n]})) END")
            warned.append(f"CASE WHEN {same} THEN 0 ELSE 1 END")
    return f"""SELECT l.path AS light, m.path AS master, round(greatest(0, CAST(1 AS DOUBLE) - ({' + '.join(cost)})), 4) AS score, CAST({' + '.join(warned)} AS INT) AS n_warnings,
 CAST(row_number() OVER (PARTITION BY l.path ORDER BY round(greatest(0, CAST(1 AS DOUBLE) - ({' + '.join(cost)})), 4) DESC, {' + '.join(warned)}, m.path) AS INT) AS rank FROM {lights} l JOIN {masters} m ON {' AND '.join(agree)} QUALIFY rank <= {k}"""


def _pool(name: str, kind: str, columns: str = _COLUMNS) -> str:
    return f"{name} AS (SELECT path, {columns} FROM {{frames}} WHERE image_type = '{kind}')"


_POOLS = ", ".join(_pool(n, k) for n, k in (("l", "LIGHT"), ("dark", "DARK"), ("darkflat", "DARKFLAT"), ("flat", "FLAT"), ("bias", "BIAS")))


def _chain(kind: str, k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT *, {n} AS level, '{p}' AS profile_used FROM ({_scored(p, 'l', p, k)})" for n, p in enumerate((kind, *calibration.FALLBACKS[kind])))
    return f"SELECT * EXCLUDE (level) FROM ({parts}) QUALIFY level = min(level) OVER (PARTITION BY light)"


def _pools(v):
    return {"dark": _frames(v, "DARK"), "flat": _frames(v, "FLAT"), "bias": _frames(v, "BIAS"), "darkflat": _frames(v, "DARKFLAT")}


@query("C08_match_calibrations", f"WITH {_POOLS} {_scored('dark', 'l', 'dark', 5)}", "score")
def _(v):
    return calibration.match_profile(_frames(v, "LIGHT"), _frames(v, "DARK"), "dark").drop("matched")


@query("C08_match_flats_by_profile", f"WITH {_POOLS} {_scored('flat', 'l', 'flat', 5)}", "score")
def _(v):
    return calibration.match_profile(_frames(v, "LIGHT"), _frames(v, "FLAT"), "flat").drop("matched")


# darks are seen with gains that lights of gain 0 lack, so that fallbacks fire
_OTHER_GAIN = "CASE WHEN gain = 100 THEN 100 ELSE 300 END"
_SPARSE = _POOLS.replace(_pool("dark", "DARK"), _pool("dark", "DARK", _COLUMNS.replace("gain AS p_gain", f"{_OTHER_GAIN} AS p_gain")))


@query("C09_match_with_fallback", f"WITH {_SPARSE} {_chain('dark', 2)}", "score")
def _(v):
    return calibration.match_with_fallback(_frames(v, "LIGHT"), _pools(v) | {"dark": _frames(v, "DARK").withColumn("gain", F.expr(_OTHER_GAIN))}, "dark", 2).drop("matched")


_BEST = " UNION ALL ".join(f"SELECT light, '{k}' AS kind, score, n_warnings FROM ({_chain(k, 1)})" for k in ("dark", "flat", "bias", "darkflat"))
_KINDS = "(VALUES ('dark'), ('flat'), ('bias'), ('darkflat')) k(kind)"


@query("D33_calibration_coverage", f"""WITH {_POOLS}, b AS ({_BEST}), n AS (SELECT count(*) AS total FROM l)
 SELECT k.kind, count(light) AS covered, max(total) - count(light) AS missing, round(coalesce(avg(score), 0), 4) AS avg_score, coalesce(min(score), 0) AS min_score, CAST(coalesce(sum(n_warnings), 0) AS BIGINT) AS warnings_count FROM {_KINDS} CROSS JOIN n LEFT JOIN b ON b.kind = k.kind GROUP BY k.kind""")
def _(v):
    return calibration.coverage(_frames(v, "LIGHT"), _pools(v))[0]


@query("D33_lights_covered", f"""WITH {_POOLS}, b AS ({_BEST}), c AS (SELECT l.path, count(b.light) AS n FROM l LEFT JOIN b ON b.light = l.path GROUP BY l.path)
 SELECT CASE WHEN n = 4 THEN 'full' WHEN n > 0 THEN 'partial' ELSE 'none' END AS coverage, count(*) AS lights FROM c GROUP BY 1""")
def _(v):
    return calibration.coverage(_frames(v, "LIGHT"), _pools(v))[1]


_UNKNOWN = {"target": "CASE WHEN path % 17 = 0 THEN NULL ELSE target END", "filter": "CASE WHEN path % 13 = 0 THEN NULL ELSE filter END", "camera": "CASE WHEN path % 11 = 0 THEN NULL ELSE camera END"}


@query("C10_match_groups", "WITH f AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _UNKNOWN.items()) + """) FROM {frames}), l AS (SELECT target, filter, avg(temperature) AS mean, arg_min(struct_pack(exposure := exposure, camera := camera), (date_obs, path)) AS one FROM f WHERE image_type = 'LIGHT' GROUP BY target, filter),
 g AS (SELECT target, filter, mean, one.exposure AS exposure, one.camera AS camera FROM l), d AS (SELECT g.*, f.temperature AS t FROM g JOIN f ON f.image_type = 'DARK' AND f.camera IS NOT DISTINCT FROM g.camera AND abs(f.exposure - g.exposure) < 0.01),
 b AS (SELECT target, filter, arg_min(t, (abs(t - mean), t)) AS best FROM d GROUP BY target, filter), k AS (SELECT d.target, d.filter, count(*) AS n, any_value(abs(best - mean)) AS delta FROM d JOIN b ON b.target IS NOT DISTINCT FROM d.target AND b.filter IS NOT DISTINCT FROM d.filter WHERE abs(best - mean) <= 2 AND abs(t - best) <= 0.5 GROUP BY d.target, d.filter),
 fl AS (SELECT filter, camera, count(*) AS n FROM f WHERE image_type = 'FLAT' GROUP BY filter, camera), bi AS (SELECT camera, count(*) AS n FROM f WHERE image_type = 'BIAS' GROUP BY camera)
 SELECT g.target, g.filter, coalesce(k.n, 0) AS n_darks, coalesce(fl.n, 0) AS n_flats, coalesce(bi.n, 0) AS n_biases, delta AS dark_temp_delta
 FROM g LEFT JOIN k ON k.target IS NOT DISTINCT FROM g.target AND k.filter IS NOT DISTINCT FROM g.filter LEFT JOIN fl ON fl.filter IS NOT DISTINCT FROM g.filter AND fl.camera IS NOT DISTINCT FROM g.camera LEFT JOIN bi ON bi.camera IS NOT DISTINCT FROM g.camera""", "dark_temp_delta")
def _(v):
    return calibration.match_groups(v.frames.withColumns({c: F.expr(e) for c, e in _UNKNOWN.items()}))


_NIGHT = "CAST(CAST(date_obs AS TIMESTAMP) - INTERVAL 12 HOUR AS DATE)"
_FLATS = f"g AS (SELECT {_NIGHT} AS night, telescope, camera, filter, binning, rotation, count(*) AS n_files, arg_min(temperature, path) AS temperature, min(path) AS first_path FROM {{frames}} WHERE image_type = 'FLAT' GROUP BY ALL)"
_BLANKED = "CASE WHEN path % 37 = 0 THEN NULL ELSE filter END AS filter, CASE WHEN path % 41 = 0 THEN '' ELSE telescope END AS telescope, CASE WHEN path % 43 = 0 THEN NULL ELSE camera END AS camera, CASE WHEN path % 211 = 0 THEN NULL ELSE date_obs END AS date_obs"


@query("D30_flat_groups", f"WITH {_FLATS} SELECT night, telescope, camera, filter, binning, rotation, n_files, temperature, first_path FROM g")
def _(v):
    return calibration.flat_groups(v.frames.where("image_type = 'FLAT'")).withColumn("first_path", F.col("files")[0]).drop("files")


@query("C11_match_flats", f"""WITH {_FLATS}, s AS (SELECT night, nullif(telescope, '') AS telescope, camera, filter, binning, count(*) AS n_lights FROM (SELECT {_NIGHT} AS night, * FROM (SELECT binning, {_BLANKED} FROM {{frames}} WHERE image_type = 'LIGHT')) GROUP BY ALL),
 m AS (SELECT s.*, g.night AS flat_night, g.telescope AS flat_telescope, g.camera AS flat_camera, g.filter AS flat_filter, g.rotation AS flat_rotation, abs(date_diff('day', s.night, g.night)) AS days FROM s JOIN g ON s.binning = g.binning AND (s.telescope IS NULL OR s.telescope = g.telescope) AND (s.camera IS NULL OR s.camera = g.camera) AND (s.filter IS NULL OR s.filter = g.filter) WHERE s.night IS NULL OR g.night IS NULL OR abs(date_diff('day', s.night, g.night)) <= 30)
 SELECT night, telescope, camera, filter, binning, n_lights, flat_night, flat_telescope, flat_camera, flat_filter, flat_rotation, CAST(days AS INT) AS days, CAST(row_number() OVER (PARTITION BY night, telescope, camera, filter, binning ORDER BY days NULLS LAST, flat_night NULLS LAST, flat_telescope, flat_camera, flat_filter, flat_rotation) AS INT) AS rank FROM m""")
def _(v):
    lights = v.frames.where("image_type = 'LIGHT'").selectExpr("binning", *_BLANKED.split(", CASE")[:1], *(f"CASE{x}" for x in _BLANKED.split(", CASE")[1:]))
    return calibration.match_flats(lights, calibration.flat_groups(v.frames.where("image_type = 'FLAT'"))).drop("flat_binning", "n_files")


@query("D31_flat_statistics", f"WITH {_FLATS} SELECT CAST(sum(n_files) AS BIGINT) AS total_flat_files, count(*) AS total_groups, count(*) FILTER (filter = 'O') AS masters_created, count(*) FILTER (filter <> 'O') AS masters_pending, count(DISTINCT night) AS nights_covered, count(DISTINCT telescope || camera) AS setups, count(DISTINCT filter) AS filters FROM g")
def _(v):
    groups = calibration.flat_groups(v.frames.where("image_type = 'FLAT'"))
    return calibration.flat_statistics(groups, groups.where("filter = 'O'"))


@query("D31_flats_by_night", f"""WITH {_FLATS} SELECT night, count(*) AS n_groups, CAST(sum(n_files) AS BIGINT) AS n_files, string_agg(DISTINCT filter, ',' ORDER BY filter) AS filters, night AS first_night, night AS last_night, count(*) FILTER (filter = 'O') AS masters_created, count(*) FILTER (filter <> 'O') AS masters_pending FROM g GROUP BY night""")
def _(v):
    groups = calibration.flat_groups(v.frames.where("image_type = 'FLAT'"))
    return calibration.flats_by(groups, groups.where("filter = 'O'"), ["night"]).withColumn("filters", F.array_join("filters", ","))


@query("D31_flats_by_setup", f"""WITH {_FLATS} SELECT telescope, camera, count(*) AS n_groups, CAST(sum(n_files) AS BIGINT) AS n_files, string_agg(DISTINCT filter, ',' ORDER BY filter) AS filters, min(night) AS first_night, max(night) AS last_night, count(*) FILTER (filter = 'O') AS masters_created, count(*) FILTER (filter <> 'O') AS masters_pending FROM g GROUP BY telescope, camera""")
def _(v):
    groups = calibration.flat_groups(v.frames.where("image_type = 'FLAT'"))
    return calibration.flats_by(groups, groups.where("filter = 'O'"), ["telescope", "camera"]).withColumn("filters", F.array_join("filters", ","))


@query("D31_pending_flats", f"WITH {_FLATS} SELECT night, telescope, camera, filter, binning, rotation, n_files, temperature, first_path FROM g WHERE filter <> 'O'")
def _(v):
    groups = calibration.flat_groups(v.frames.where("image_type = 'FLAT'"))
    return calibration.pending_flats(groups, groups.where("filter = 'O'")).withColumn("first_path", F.col("files")[0]).drop("files")


@query("D32_flat_coverage", f"""WITH {_FLATS}, h AS (SELECT night, filter, sum(n_files) AS n FROM g GROUP BY night, filter) SELECT d.night, r.filter, CAST(coalesce(n, 0) AS BIGINT) AS n_files, CASE WHEN coalesce(n, 0) >= 3 THEN 'complete' WHEN coalesce(n, 0) > 0 THEN 'insufficient' ELSE 'missing' END AS status
 FROM (SELECT DISTINCT night FROM g) d CROSS JOIN (SELECT DISTINCT filter FROM {{frames}} WHERE image_type = 'LIGHT') r LEFT JOIN h ON h.night = d.night AND h.filter = r.filter""")
def _(v):
    return calibration.flat_coverage(calibration.flat_groups(v.frames.where("image_type = 'FLAT'")), v.frames.where("image_type = 'LIGHT'").select("filter"), 3)
