"""Further registered queries: rollups, name resolution, pixel statistics and dark hours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sky
from ..operators import cluster, images, joins, ordered, stats
from .catalog import query


@query("D40_year_stats", """WITH o AS (SELECT *, year(observation_date) AS y, month(observation_date) AS m FROM {observations}), b AS (SELECT y, m, sum(exposure_time) AS e FROM o GROUP BY y, m QUALIFY row_number() OVER (PARTITION BY y ORDER BY e DESC, m) = 1)
 SELECT CAST(o.y AS INT) AS year, count(DISTINCT observation_date) AS nights, sum(exposure_time) AS total_exposure, count(DISTINCT target_id) AS targets, CAST(sum(frame_count) AS BIGINT) / count(DISTINCT observation_date) AS frames_a_night, CAST(any_value(b.m) AS INT) AS best_month FROM o JOIN b ON o.y = b.y GROUP BY o.y""", "frames_a_night")
def _(v):
    o = v.observations.withColumns({"year": F.year("observation_date"), "month": F.month("observation_date")})
    months = o.groupBy("year", "month").agg(F.sum("exposure_time").alias("e")).groupBy("year").agg(F.max_by("month", F.struct(F.col("e"), -F.col("month"))).alias("best_month"))
    years = o.groupBy("year").agg(F.countDistinct("observation_date").alias("nights"), F.sum("exposure_time").alias("total_exposure"), F.countDistinct("target_id").alias("targets"), (F.sum("frame_count") / F.countDistinct("observation_date")).alias("frames_a_night"))
    return years.join(months, "year")


@query("D41_day_rollup", "SELECT observation_date, count(DISTINCT target_id) AS n_targets, CAST(sum(frame_count) AS BIGINT) AS frames, sum(exposure_time) AS exposure, array_to_string(list_sort(list_distinct(list(name))), '; ') AS names FROM {observations} JOIN {targets} ON id = target_id GROUP BY observation_date")
def _(v):
    joined = v.observations.join(v.targets.select("id", "name"), F.col("id") == F.col("target_id"))
    return joined.groupBy("observation_date").agg(F.countDistinct("target_id").alias("n_targets"), F.sum("frame_count").alias("frames"), F.sum("exposure_time").alias("exposure"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


@query("B44_image_scale", "SELECT telescope, pixel_size / focal_length * 206.265 AS scale, pixel_size / focal_length * 206.265 * 4096 / 3600 AS fov FROM {equipment}", "scale fov")
def _(v):
    scale = sky.image_scale(F.col("pixel_size"), F.col("focal_length"))
    return v.equipment.select("telescope", scale.alias("scale"), sky.field_of_view(scale, F.lit(4096)).alias("fov"))


@query("B41_aitoff", "SELECT id, -radians(CASE WHEN ra_deg > 180 THEN ra_deg - 360 ELSE ra_deg END) AS longitude, radians(dec_deg) AS latitude FROM {targets}", "longitude latitude")
def _(v):
    return v.targets.select("id", sky.aitoff_longitude(F.col("ra_deg")).alias("longitude"), F.radians("dec_deg").alias("latitude"))


@query("C14_resolve_names", """WITH q AS (SELECT DISTINCT event_id, CASE event_id % 3 WHEN 0 THEN 'small ring ' || CAST(event_id % 200 AS STRING) WHEN 1 THEN 'SMALL  RING' || CAST(event_id % 200 AS STRING) ELSE 'small ring' END AS asked FROM {exposures}),
 m AS (SELECT event_id, id, 1 AS p FROM q JOIN {targets} ON name = asked UNION ALL SELECT event_id, id, 2 FROM q JOIN {targets} ON upper(replace(name, ' ', '')) = upper(replace(asked, ' ', '')) UNION ALL SELECT event_id, min(id), 3 FROM q JOIN {targets} ON canonical_name = asked GROUP BY event_id)
 SELECT event_id, id FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p, id) = 1""")
def _(v):
    asked = v.exposures.selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 'small ring ' || CAST(event_id % 200 AS STRING) WHEN 1 THEN 'SMALL  RING' || CAST(event_id % 200 AS STRING) ELSE 'small ring' END AS asked")
    squeezed = lambda c: F.upper(F.replace(F.col(c), F.lit(" "), F.lit("")))
    canonical = v.targets.groupBy("canonical_name").agg(F.min("id").alias("id"))
    found = asked.join(v.targets, F.col("asked") == F.col("name")).select("event_id", "id", F.lit(1).alias("p"))
    found = found.unionByName(asked.withColumn("k", squeezed("asked")).join(v.targets.withColumn("k", squeezed("name")), "k").select("event_id", "id", F.lit(2).alias("p")))
    found = found.unionByName(asked.join(canonical, F.col("asked") == F.col("canonical_name")).select("event_id", "id", F.lit(3).alias("p")))
    return found.groupBy("event_id").agg(F.min_by("id", F.struct("p", "id")).alias("id"))


_RESOLVED = """CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"main_id": "NAME ' || id || '", "aliases": ["HD ' || CAST(floor(id / 2) AS INT) || '", "IC ' || id || '"]}' WHEN 2 THEN '{"main_id": "", "aliases": []}' ELSE '{broken ' || id END"""
_ASKED = "CASE event_id % 7 WHEN 0 THEN 'name  ' || CAST(event_id % 200 AS STRING) WHEN 1 THEN 'hd' || CAST(event_id % 200 AS STRING) WHEN 2 THEN 'ic ' || CAST(event_id % 200 AS STRING) WHEN 3 THEN '{first}' || CAST(event_id % 200 AS STRING) WHEN 4 THEN upper('{first}') WHEN 5 THEN '{first}' ELSE ' ' END"


@query("C14_resolve_aliases", f"""WITH t AS (SELECT id, name, canonical_name, {_RESOLVED} AS d FROM {{targets}}), j AS (SELECT id, upper(replace(d ->> '$.main_id', ' ', '')) AS k FROM t WHERE json_valid(d) UNION ALL SELECT id, upper(replace(unnest(from_json(d -> '$.aliases', '["VARCHAR"]')), ' ', '')) FROM t WHERE json_valid(d)),
 q AS (SELECT event_id, {_ASKED.format(first='small ring ')} AS asked FROM events), s AS (SELECT *, upper(replace(asked, ' ', '')) AS k FROM q), l AS (SELECT 1 AS step, name AS k, id FROM t UNION ALL SELECT 1, canonical_name, id FROM t), u AS (SELECT k, min(id) AS id FROM l GROUP BY k), w AS (SELECT upper(replace(k, ' ', '')) AS k, min(id) AS id FROM l GROUP BY 1), y AS (SELECT k, min(id) AS id FROM j WHERE k <> '' GROUP BY k)
 SELECT event_id, asked, coalesce(u.id, w.id, y.id) AS id, CASE WHEN u.id IS NOT NULL THEN 1 WHEN w.id IS NOT NULL THEN 2 WHEN y.id IS NOT NULL THEN 3 END AS step FROM s LEFT JOIN u ON u.k = asked LEFT JOIN w ON w.k = s.k LEFT JOIN y ON y.k = s.k""")
def _(v):
    asked = v.events.selectExpr("event_id", f"{_ASKED.format(first='small ring ')} AS asked")
    targets = v.targets.selectExpr("id", "name", "canonical_name", f"{_RESOLVED} AS data")
    return joins.resolve_local(asked, targets, data="data")


@query("F02_cluster_summary", """WITH RECURSIVE e AS (SELECT a.id AS u, b.id AS v FROM {targets} a JOIN {targets} b ON a.id <> b.id AND abs(a.dec_deg - b.dec_deg) <= 1.5 WHERE degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(b.dec_deg - a.dec_deg) / 2), 2) + cos(radians(a.dec_deg)) * cos(radians(b.dec_deg)) * pow(sin(radians(b.ra_deg - a.ra_deg) / 2), 2))))) <= 1.5),
 r AS (SELECT id, id AS c FROM {targets} UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v), k AS (SELECT id, min(c) AS cluster FROM r GROUP BY id), t AS (SELECT target_id, sum(exposure_time) AS e FROM {observations} GROUP BY target_id)
 SELECT cluster, count(*) AS members, coalesce(sum(e), 0) AS exposure FROM k LEFT JOIN t ON target_id = id GROUP BY cluster""")
def _(v):
    found = cluster.cluster_targets(v.targets, 1.5, 1)
    return cluster.cluster_summary(found, v.targets, stats.target_totals(v.observations)).select("cluster", "members", "exposure")


@query("G10_background", """WITH s AS (SELECT image_id, avg(value) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS m, quantile_cont(value, 0.5) FILTER (x < 2 OR x > 5) AS background, stddev_samp(value) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS spread FROM {pixels} GROUP BY image_id)
 SELECT image_id, m - background AS signal, background, spread, (m - background) / nullif(spread, 0) AS snr FROM s""", "signal background spread snr")
def _(v):
    return images.background_subtracted(v.pixels, "x between 2 and 5 and y between 2 and 5", "x < 2 or x > 5")


@query("G11_histogram", "WITH e AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM {pixels} GROUP BY image_id) SELECT p.image_id, CAST(least(floor((value - lo) / (hi - lo) * 16), 15) AS INT) AS bin, count(*) AS n FROM {pixels} p JOIN e ON e.image_id = p.image_id GROUP BY p.image_id, bin")
def _(v):
    return images.histogram(v.pixels, 16)


@query("I06_tagged", "SELECT tag, count(*) AS n_targets, count(DISTINCT canonical_name) AS n_names FROM {tags} g JOIN {target_tags} l ON g.tag_id = l.tag_id JOIN {targets} t ON t.id = l.target_id GROUP BY tag")
def _(v):
    joined = v.tags.join(v.target_tags, "tag_id").join(v.targets, F.col("id") == F.col("target_id"))
    return joined.groupBy("tag").agg(F.count("*").alias("n_targets"), F.countDistinct("canonical_name").alias("n_names"))


@query("E10_ranked_nights", "WITH n AS (SELECT target_id, observation_date, sum(exposure_time) AS e FROM {observations} GROUP BY target_id, observation_date) SELECT target_id, observation_date, e AS exposure, CAST(row_number() OVER (PARTITION BY target_id ORDER BY e DESC, observation_date) AS INT) AS rank FROM n QUALIFY rank <= 3")
def _(v):
    nights = v.observations.groupBy("target_id", "observation_date").agg(F.sum("exposure_time").alias("exposure"))
    return ordered.top_per(nights, ["target_id"], [F.desc("exposure"), "observation_date"], 3)


@query("H05_top_exposures", "SELECT event_id, hfr FROM {exposures} ORDER BY hfr, event_id LIMIT 20", "hfr")
def _(v):
    return v.exposures.select("event_id", "hfr").orderBy("hfr", "event_id").limit(20)


@query("B19_separation", "SELECT id, degrees(acos(greatest(-1.0, least(1.0, sin(radians(dec_deg)) * sin(radians(10.0)) + cos(radians(dec_deg)) * cos(radians(10.0)) * cos(radians(ra_deg - 180.0)))))) AS separation FROM {targets}", "separation")
def _(v):
    return v.targets.select("id", joins.angular_separation(F.col("ra_deg"), F.col("dec_deg"), F.lit(180.0), F.lit(10.0)).alias("separation"))


@query("G12_compare_profiles", """WITH a AS (SELECT image_id, x + 8 * y AS k, value FROM {pixels}), b AS (SELECT image_id, x AS k, avg(value) AS value FROM {pixels} GROUP BY image_id, x),
 l AS (SELECT image_id, count(*) AS n FROM a GROUP BY image_id), m AS (SELECT image_id, count(*) AS m FROM b GROUP BY image_id),
 t AS (SELECT a.image_id, a.k, a.value, a.k * (m - 1) / (n - 1) AS t, CAST(floor(a.k * (m - 1) / (n - 1)) AS INT) AS lo, m FROM a JOIN l ON l.image_id = a.image_id JOIN m ON m.image_id = a.image_id),
 s AS (SELECT t.image_id, t.value AS u, p.value + (q.value - p.value) * (t.t - t.lo) AS v FROM t JOIN b p ON p.image_id = t.image_id AND p.k = t.lo JOIN b q ON q.image_id = t.image_id AND q.k = least(t.lo + 1, t.m - 1)),
 e AS (SELECT image_id, min(u) AS ul, max(u) AS uh, min(v) AS vl, max(v) AS vh FROM s GROUP BY image_id),
 z AS (SELECT s.image_id, (u - ul) / (uh - ul) AS u, (v - vl) / (vh - vl) AS v FROM s JOIN e ON e.image_id = s.image_id)
 SELECT image_id, count(*) AS n, sqrt(avg((u - v) * (u - v))) AS rmse, avg(abs(u - v)) AS mae, corr(u, v) AS r, max(u) - max(v) AS peak_diff, avg(u) - avg(v) AS mean_diff FROM z GROUP BY image_id""", "rmse mae r peak_diff mean_diff")
def _(v):
    columns = v.pixels.groupBy("image_id", F.col("x").alias("at")).agg(F.avg("value").alias("value"))
    return images.compare_profiles(v.pixels.select("image_id", (F.col("x") + 8 * F.col("y")).alias("at"), "value"), columns, "image_id", "at", "value")
