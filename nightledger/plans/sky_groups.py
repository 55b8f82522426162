"""Registered queries over clusters, merges, mosaics, duplicates and star fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cluster, groups, stats
from .catalog import _HAVERSINE, query

_D = _HAVERSINE.replace("{a}", "a").replace("{b}", "b")
_CLUSTERS = f"""e AS (SELECT a.id AS u, b.id AS v FROM {{targets}} a JOIN {{targets}} b ON a.id <> b.id AND abs(a.dec_deg - b.dec_deg) <= 1.5 WHERE {_D} <= 1.5), r AS (SELECT id, id AS c FROM {{targets}} UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v), k AS (SELECT id, min(c) AS cluster FROM r GROUP BY id)"""
_SIMILAR = "(strpos({x}, {y}) > 0 OR strpos({y}, {x}) > 0)"
_NEAR = f"""n AS (SELECT id, cluster, CAST(ra_deg AS DOUBLE) AS ra_deg, CAST(dec_deg AS DOUBLE) AS dec_deg, canonical_name AS nm, upper(replace(canonical_name, ' ', '')) AS p FROM k JOIN {{targets}} t USING (id)), q AS (SELECT a.cluster, {_D} * 60 AS g, a.p AS pa, b.p AS pb FROM n a JOIN n b ON a.cluster = b.cluster AND a.id < b.id), m AS (SELECT DISTINCT cluster FROM q WHERE g <= 5 OR (g <= 15 AND {_SIMILAR.format(x='pa', y='pb')}))"""


def _clusters(v):
    return cluster.cluster_targets(v.targets, 1.5, 1)


@query("F02_cluster_radii", f"""WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster, count(*) AS members, sum(cos(radians(dec_deg)) * cos(radians(ra_deg))) AS x, sum(cos(radians(dec_deg)) * sin(radians(ra_deg))) AS y, sum(sin(radians(dec_deg))) AS z FROM k JOIN {{targets}} USING (id) GROUP BY cluster), b AS (SELECT cluster, members, degrees(atan2(y, x)) AS ra_deg, degrees(atan2(z, sqrt(x * x + y * y))) AS dec_deg FROM s)
 SELECT b.cluster, members, CASE WHEN members > 1 THEN max({_D}) ELSE 0 END AS radius FROM k JOIN {{targets}} a USING (id) JOIN b ON b.cluster = k.cluster GROUP BY b.cluster, members""", "radius")
def _(v):
    return groups.cluster_radii(_clusters(v), v.targets)


@query("F03_similar_names", f"""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NGC 00' || user_id WHEN 1 THEN 'M' || user_id WHEN 2 THEN NULL ELSE 'x ' || event_type END AS a, CASE event_id % 3 WHEN 0 THEN 'ngc-' || user_id WHEN 1 THEN 'M ' || user_id || ' - Andromeda' ELSE 'X' END AS b FROM events), q AS (SELECT event_id, a IS NOT NULL AS have, upper(regexp_replace(a, '[ _-]', '', 'g')) AS x, upper(regexp_replace(b, '[ _-]', '', 'g')) AS y FROM p)
 SELECT event_id, coalesce(have AND ({_SIMILAR.format(x='x', y='y')} OR regexp_replace(x, '^(NGC|M)0+', '\\1') = regexp_replace(y, '^(NGC|M)0+', '\\1')), false) AS similar_names FROM q""")
def _(v):
    e = v.events.selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'NGC 00' || user_id WHEN 1 THEN 'M' || user_id WHEN 2 THEN NULL ELSE 'x ' || event_type END AS a", "CASE event_id % 3 WHEN 0 THEN 'ngc-' || user_id WHEN 1 THEN 'M ' || user_id || ' - Andromeda' ELSE 'X' END AS b")
    return e.select("event_id", groups.similar_names(F.col("a"), F.col("b")).alias("similar_names"))


# ten times as dense, so that targets lie within minutes of one another
_DENSE = "tt AS (SELECT id, name, canonical_name, CAST(ra_deg AS DOUBLE) * 0.1 AS ra_deg, CAST(dec_deg AS DOUBLE) * 0.1 AS dec_deg FROM {targets}), " + _CLUSTERS.replace("{targets}", "tt").replace("1.5", "0.25")
_NEAR_DENSE = _NEAR.replace("{targets}", "tt")


def _dense(v):
    return v.targets.withColumns({c: F.col(c).cast("double") * 0.1 for c in ("ra_deg", "dec_deg")})


@query("F04_suggest_merges", f"""WITH RECURSIVE {_DENSE}, {_NEAR_DENSE}, t AS (SELECT target_id, sum(exposure_time) AS e FROM {{observations}} GROUP BY target_id), h AS (SELECT n.*, coalesce(e, 0) AS e FROM n JOIN m USING (cluster) LEFT JOIN t ON target_id = id), d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY e DESC, id) = 1),
 f AS (SELECT a.id AS source, b.id AS dest, {_D} * 60 AS g, {_SIMILAR.format(x='a.p', y='b.p')} AS name_match FROM h a JOIN d b ON a.cluster = b.cluster AND a.id <> b.id) SELECT source, dest, round(g, 2) AS distance_arcmin, name_match, CASE WHEN g <= 5 THEN 'strong' ELSE 'moderate' END AS strength FROM f WHERE g <= 5 OR (g <= 15 AND name_match)""")
def _(v):
    return groups.suggest_merges(cluster.cluster_targets(_dense(v), 0.25, 1), _dense(v), stats.target_totals(v.observations))


@query("F05_cluster_stats", f"""WITH RECURSIVE {_DENSE}, {_NEAR_DENSE}, s AS (SELECT cluster, count(*) AS members FROM k GROUP BY cluster) SELECT CAST(sum(members) AS BIGINT) AS total_targets, CAST(sum(CASE WHEN members > 1 THEN members ELSE 0 END) AS BIGINT) AS clustered_targets, count(*) AS num_clusters, count(*) FILTER (members = 1) AS singletons, count(*) FILTER (members > 1) AS multi_target_clusters, (SELECT count(*) FROM m) AS merge_candidates, max(members) AS largest_cluster_size FROM s""")
def _(v):
    return groups.cluster_stats(cluster.cluster_targets(_dense(v), 0.25, 1), _dense(v)).drop("avg_cluster_radius_arcmin")


# frames of the dense targets, up to three of one position
_MOSAIC = f"""{_DENSE}, n AS (SELECT id * 10 + j AS id, cluster * 10 AS "group", ra_deg, dec_deg FROM tt JOIN k USING (id), (SELECT unnest([0, 1, 2]) AS j) WHERE j <= id % 3), a0 AS (SELECT "group" AS g, quantile_cont(ra_deg, 0.5) AS ra0, quantile_cont(dec_deg, 0.5) AS dec0, count(*) AS size FROM n GROUP BY g),
 s AS (SELECT a."group" AS g, quantile_cont({_D}, 0.5) AS tile FROM n a JOIN n b ON a."group" = b."group" AND a.id < b.id WHERE {_D} > 0.01 AND {_D} < 0.25 GROUP BY g),
 p AS (SELECT id, "group", ra_deg, dec_deg, size, coalesce(tile, 1) AS tile, radians(ra_deg) AS a, radians(dec_deg) AS d, radians(ra0) AS ra0, radians(dec0) AS dec0 FROM n JOIN a0 ON a0.g = "group" LEFT JOIN s ON s.g = "group"), c AS (SELECT *, sin(dec0) * sin(d) + cos(dec0) * cos(d) * cos(a - ra0) AS c FROM p),
 x AS (SELECT *, CAST(round_even(degrees(cos(d) * sin(a - ra0) / c) / tile, 0) AS INT) AS cx, CAST(round_even(degrees((cos(dec0) * sin(d) - sin(dec0) * cos(d) * cos(a - ra0)) / c) / tile, 0) AS INT) AS cy FROM c), y AS (SELECT id, "group", ra_deg, dec_deg, size, cy - min(cy) OVER (PARTITION BY "group") AS "row", cx - min(cx) OVER (PARTITION BY "group") AS col FROM x)"""


def _mosaic_frames(v):
    return _dense(v).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")))).select((F.col("id") * 10 + F.col("j")).alias("id"), "ra_deg", "dec_deg")


@query("F08_mosaic_panels", f"""WITH RECURSIVE {_MOSAIC} SELECT id, "group", "row", col, 'R' || ("row" + 1) || 'C' || (col + 1) AS panel FROM y""")
def _(v):
    return groups.mosaic_panels(_mosaic_frames(v), 0.25)


@query("F08_largest_mosaic", f"""WITH RECURSIVE {_MOSAIC} SELECT "group", 'R' || ("row" + 1) || 'C' || (col + 1) AS panel, "row", col, count(*) AS n_files, quantile_cont(ra_deg, 0.5) AS ra_deg, quantile_cont(dec_deg, 0.5) AS dec_deg FROM y WHERE "group" = (SELECT "group" FROM y ORDER BY size DESC, "group" LIMIT 1) GROUP BY ALL""", "ra_deg dec_deg")
def _(v):
    frames = _mosaic_frames(v)
    return groups.panel_centres(frames, groups.mosaic_panels(frames, 0.25, largest=True))


_PANELS = "CASE o_orderkey % 6 WHEN 0 THEN 'M31_Row' || (o_orderkey % 3 + 1) || '_Col' || (o_orderkey % 4 + 2) || '_L' WHEN 1 THEN 'M42 ' || (o_orderkey % 3 + 1) || 'x' || (o_orderkey % 4 + 2) WHEN 2 THEN 'Veil-Panel ' || (o_orderkey % 5 + 2) WHEN 3 THEN 'a_P' || (o_orderkey % 5 + 2) ELSE 'plain' END"
_PANEL_SQL = f"""WITH p AS (SELECT o_orderkey, '/x/' || {_PANELS} || '.fits' AS path, o_orderkey % 6 AS k FROM orders), r AS (SELECT *, CASE k WHEN 0 THEN o_orderkey % 3 + 1 WHEN 1 THEN o_orderkey % 3 + 1 ELSE 0 END AS r, CASE k WHEN 0 THEN o_orderkey % 4 + 2 WHEN 1 THEN o_orderkey % 4 + 2 ELSE o_orderkey % 5 + 2 END AS c FROM p WHERE k < 4), e AS (SELECT min(r) AS r0, min(c) AS c0 FROM r)"""


def _panel_files(v):
    return v.orders.selectExpr("o_orderkey", f"'/x/' || {_PANELS} || '.fits' AS path", "o_orderstatus AS filter", "o_totalprice AS exposure")


@query("F09_panels_by_name", f"{_PANEL_SQL} SELECT path, CAST(r - r0 AS INT) AS \"row\", CAST(c - c0 AS INT) AS col, 'R' || (r - r0 + 1) || 'C' || (c - c0 + 1) AS panel, CASE k WHEN 0 THEN 'M31' WHEN 1 THEN 'M42' WHEN 2 THEN 'Veil' ELSE 'a' END AS target FROM r, e")
def _(v):
    return groups.panels_by_name(_panel_files(v), "path")


@query("D37_mosaic_stats", f"{_PANEL_SQL} SELECT 'R' || (r - r0 + 1) || 'C' || (c - c0 + 1) AS panel, count(*) AS n_files, count(DISTINCT o_orderstatus) AS n_filters, sum(o_totalprice) AS exposure FROM r JOIN orders USING (o_orderkey), e GROUP BY panel", "exposure")
def _(v):
    files = _panel_files(v)
    panels = groups.panels_by_name(files.select("path").distinct(), "path")
    return groups.mosaic_stats(files.join(panels, "path"))


_HEADERS = {
    "naxis1": "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 4000 + 100 * (o_custkey % 3) END", "naxis2": "3000 + 100 * (o_custkey % 4)", "cdelt1": "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(-0.0003 * (1 + o_custkey % 5) AS DOUBLE) END", "cdelt2": "CAST(0.0004 AS DOUBLE)",
    "cd1_1": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(0.0003 AS DOUBLE) END", "cd1_2": "CAST(NULL AS DOUBLE)", "cd2_1": "CAST(0.0001 * (o_custkey % 3) AS DOUBLE)", "cd2_2": "CAST(0.0004 AS DOUBLE)",
}
_HEADER_COLUMNS = [f"{e} AS {c}" for c, e in _HEADERS.items()]


@query("D37_mosaic_field", f"""{_PANEL_SQL}, l AS (SELECT 'R' || (r - r0 + 1) || 'C' || (c - c0 + 1) AS panel, r, c, '/' || o_orderkey || path AS path, o_orderkey FROM r, e), h AS (SELECT '/' || o_orderkey || path AS path, {', '.join(_HEADER_COLUMNS)} FROM p JOIN orders USING (o_orderkey) WHERE o_orderkey % 5 <> 0),
 m AS (SELECT path, naxis1, naxis2, cdelt1 IS NULL AND cd1_1 IS NOT NULL AS matrix, * EXCLUDE (path, naxis1, naxis2) FROM h), q AS (SELECT path, abs(CASE WHEN matrix THEN cd1_1 ELSE cdelt1 END) * naxis1 AS w, CASE WHEN matrix THEN sqrt(cd2_1 * cd2_1 + cd2_2 * cd2_2) ELSE cdelt2 END * naxis2 AS h FROM m),
 f AS (SELECT panel, CASE WHEN w IS NOT NULL THEN w END AS w, CASE WHEN w IS NOT NULL THEN h END AS h FROM l JOIN q USING (path) QUALIFY row_number() OVER (PARTITION BY panel ORDER BY path) = 1), g AS (SELECT count(DISTINCT panel) AS total_panels, count(*) AS total_files, CAST(max(r) - min(r) + 1 AS INT) AS grid_rows, CAST(max(c) - min(c) + 1 AS INT) AS grid_cols FROM l)
 SELECT g.*, round(quantile_cont(w, 0.5) * any_value(grid_cols) * 60, 1) AS width_arcmin, round(quantile_cont(h, 0.5) * any_value(grid_rows) * 60, 1) AS height_arcmin FROM f, g GROUP BY ALL""")
def _(v):
    files = v.orders.selectExpr(f"'/' || o_orderkey || '/x/' || {_PANELS} || '.fits' AS path", "o_orderkey", "o_custkey")
    return groups.mosaic_field(groups.panels_by_name(files.select("path"), "path"), files.where("o_orderkey % 5 <> 0").selectExpr("path", *_HEADER_COLUMNS))


@query("F10_duplicate_files", """WITH f AS (SELECT path, file_id, regexp_replace(path, '(\\.fits\\.fz|\\.fits|\\.xisf)$', '') AS base, CASE WHEN path LIKE '%.xisf' THEN 0 WHEN path LIKE '%.fits' THEN 1 WHEN path LIKE '%.fits.fz' THEN 2 END AS k, CASE WHEN file_id % 9 = 0 THEN NULL ELSE length // 40 END AS date_obs, file_id % 3 AS filter FROM (SELECT replace(replace(path, '/' || file_id || '.', '/' || (file_id // 2) || '.'), 'x', 'x') AS path, file_id, length FROM {files})),
 a AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k, path) = 1 AS stays FROM f WHERE k IS NOT NULL), b AS (SELECT *, stays AND date_obs IS NOT NULL AND row_number() OVER (PARTITION BY stays, date_obs, filter ORDER BY path) > 1 AS again FROM a) SELECT path, stays AND NOT again AS keep, CASE WHEN NOT stays THEN 'format' WHEN again THEN 'signature' END AS reason FROM b""")
def _(v):
    files = v.files.select(F.expr("replace(path, '/' || file_id || '.', '/' || (file_id div 2) || '.')").alias("path"), F.when(F.col("file_id") % 9 != 0, F.floor(F.col("length") / 40)).alias("date_obs"), (F.col("file_id") % 3).alias("filter"))
    return groups.duplicate_files(files, "path", ["filter"], "date_obs")


@query("F10_equal_contents", "SELECT path, path > min(path) OVER (PARTITION BY sha256(content)) AS duplicate FROM {files}")
def _(v):
    return groups.equal_contents(v.files, "path", "content")


@query("F11_group_targets", "SELECT CASE target_name WHEN 'NGC 7' THEN 'Nine' WHEN 'NGC 9' THEN 'Nine' ELSE target_name END AS \"group\", count(*) AS n, sum(exposure_seconds) AS total_seconds FROM {exposures} GROUP BY 1")
def _(v):
    aliases = v.spark.createDataFrame([("NGC 7", "Nine"), ("NGC 9", "Nine")], "alias string, canonical string")
    found = groups.group_targets(v.exposures.withColumn("raw", F.replace("target_name", F.lit("NGC "), F.lit("ngc00"))), text.normalize_target(F.col("raw")), aliases)
    return found.groupBy("group").agg(F.count("*").alias("n"), F.sum("exposure_seconds").alias("total_seconds"))


@query("E15_split_by_focal", """WITH f AS (SELECT path, target, CASE WHEN focal_length IS NULL THEN NULL WHEN target IN ('M 1', 'M 2') THEN CAST(450 + path % 7 AS DOUBLE) WHEN path % 3 = 0 THEN 305.0 ELSE CAST(450 + path % 7 AS DOUBLE) END AS focal FROM {frames}) SELECT path, CASE WHEN target IN ('M 1', 'M 2') THEN target WHEN focal = 305 THEN target || ' (305mm)' ELSE target || ' (' || CAST(CAST(min(CASE WHEN focal > 305 THEN focal END) OVER (PARTITION BY target) AS INT) AS STRING) || 'mm)' END AS "group" FROM f""")
def _(v):
    focal = F.when(F.col("focal_length").isNull(), None).when(F.col("target").isin("M 1", "M 2"), 450 + F.col("path") % 7).when(F.col("path") % 3 == 0, 305).otherwise(450 + F.col("path") % 7)
    return groups.split_by_focal(v.frames.select("path", "target", focal.cast("double").alias("focal")), "target", "focal").select("path", "group")


_FIELD = "SELECT l_suppkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS star, CAST((l_partkey * 37 + l_orderkey) % 3000 AS DOUBLE) AS x, CAST((l_orderkey * 53 + l_linenumber) % 2000 AS DOUBLE) AS y, CAST(1 + 40 * l_discount AS DOUBLE) AS fwhm FROM lineitem"


def _field(v):
    v.lineitem.createOrReplaceTempView("_field_rows")
    return v.spark.sql(_FIELD.replace("FROM lineitem", "FROM _field_rows"))


@query("F12_local_outliers", f"""WITH s AS ({_FIELD}), n AS (SELECT a.frame, a.star, a.fwhm, b.fwhm AS w FROM s a JOIN s b ON a.frame = b.frame AND a.star <> b.star QUALIFY row_number() OVER (PARTITION BY a.frame, a.star ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.star) <= 6),
 m AS (SELECT frame, star, quantile_cont(w, 0.5) AS m, count(*) AS k FROM n GROUP BY frame, star), d AS (SELECT n.frame, n.star, any_value(n.fwhm) AS f, any_value(m) AS m, any_value(k) AS k, quantile_cont(abs(w - m), 0.5) * 1.4826 AS s FROM n JOIN m ON n.frame = m.frame AND n.star = m.star GROUP BY n.frame, n.star)
 SELECT s.frame, s.star, coalesce(k < 6 OR abs(f - m) <= 3 * CASE WHEN d.s < 1e-6 THEN CASE WHEN m > 0 THEN 0.1 * m ELSE 1 END ELSE d.s END, true) AS keep FROM s LEFT JOIN d ON s.frame = d.frame AND s.star = d.star""")
def _(v):
    return groups.local_outliers(_field(v))


@query("F13_fwhm_grid", f"""WITH s AS ({_FIELD}), d AS (SELECT a.frame, a.star, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM s a JOIN s b ON a.frame = b.frame AND a.star <> b.star GROUP BY a.frame, a.star), h AS (SELECT frame, greatest(2 * quantile_cont(d, 0.5), 3000 / 2.0) AS h FROM d GROUP BY frame HAVING count(*) >= 3),
 g AS (SELECT CAST(i % 4 AS INT) AS gx, CAST(i // 4 AS INT) AS gy FROM range(16) t(i)), w AS (SELECT s.frame, gx, gy, fwhm, exp(-(pow((gx + 0.5) * 750 - x, 2) + pow((gy + 0.5) * 500 - y, 2)) / (2 * h * h)) AS w FROM s JOIN h ON h.frame = s.frame, g) SELECT frame, gx, gy, sum(w * fwhm) / sum(w) AS fwhm FROM w GROUP BY frame, gx, gy""", "fwhm")
def _(v):
    return groups.fwhm_grid(_field(v), 3000.0, 2000.0, 4)
