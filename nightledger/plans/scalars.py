"""Registered queries of the scalar functions, upserts, clusters and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sky, text
from ..operators import cluster, joins, stats, upserts
from .catalog import query

_NUMBERS = "CASE event_id % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'nan' WHEN 2 THEN '12.5x' WHEN 3 THEN CAST(event_id AS STRING) || '.5' WHEN 4 THEN '' ELSE ' ' || CAST(event_id % 7 AS STRING) || ' ' END"
_NAMES = "CASE event_id % 7 WHEN 0 THEN 'M' || CAST(event_id % 110 AS STRING) WHEN 1 THEN 'ngc  0' || CAST(event_id % 900 AS STRING) WHEN 2 THEN 'Sh2 ' || CAST(event_id % 300 AS STRING) WHEN 3 THEN 'Master Dark ' || CAST(event_id % 9 AS STRING) WHEN 4 THEN 'vdB-' || CAST(event_id % 50 AS STRING) WHEN 5 THEN ' Comet  X ' ELSE 'IC' || CAST(event_id % 80 AS STRING) || ' mosaic' END"


@query("B01_safe_numbers", f"WITH n AS (SELECT event_id, trim({_NUMBERS}) AS t FROM {{exposures}}) SELECT event_id, CASE WHEN t NOT IN ('', '-', 'N/A', 'NaN', 'nan', 'null') THEN TRY_CAST(t AS DOUBLE) END AS number, CAST(round_even(CASE WHEN t NOT IN ('', '-', 'N/A', 'NaN', 'nan', 'null') THEN TRY_CAST(t AS DOUBLE) END, 0) AS BIGINT) AS whole FROM n")
def _(v):
    rows = v.exposures.selectExpr("event_id", f"{_NUMBERS} AS t")
    return rows.select("event_id", text.safe_double(F.col("t")).alias("number"), text.safe_int(F.col("t")).alias("whole"))


@query("B02_parse_timestamp", "SELECT event_id, CAST(date_trunc('second', timestamp) AS TIMESTAMP) AS parsed FROM {exposures}")
def _(v):
    layouts = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    written = F.lit(None).cast("string")
    for k, layout in enumerate(layouts):
        written = F.when(F.col("event_id") % 4 == k, F.date_format("timestamp", layout)).otherwise(written)
    return v.exposures.select("event_id", text.parse_timestamp(written).cast("timestamp_ntz").alias("parsed"))


@query("B03_night_date", "SELECT event_id, CAST(timestamp - INTERVAL 12 HOUR AS DATE) AS night FROM {exposures}")
def _(v):
    return v.exposures.select("event_id", text.night_date(F.col("timestamp")).alias("night"))


@query("B04_astro_night", "SELECT event_id, CAST(make_timestamp(epoch_us(timestamp) + CAST((event_id % 360 - 180) / 15 * 3600000000 AS BIGINT) - 43200000000) AS DATE) AS night FROM {exposures}")
def _(v):
    return v.exposures.select("event_id", text.astro_night(F.col("timestamp"), F.col("event_id") % 360 - 180).alias("night"))


@query("B05_normalize_target", f"""WITH n AS (SELECT event_id, trim(regexp_replace({_NAMES}, '\\s+', ' ', 'g')) AS t FROM {{exposures}}), p AS (SELECT *, '(?i)^(Barnard|Sh\\s*2|Abell|Stock|NGC|LBN|LDN|Ced|Arp|PGC|UGC|vdB|RCW|Mel|IC|Cr|Tr|M|B|C)[\\s\\-]*(\\d+.*)$' AS e FROM n),
 x AS (SELECT event_id, t, lower(regexp_replace(regexp_extract(t, e, 1), '\\s', '', 'g')) AS k, ltrim(regexp_extract(t, e, 2), '0') AS num FROM p)
 SELECT event_id, CASE k WHEN '' THEN t WHEN 'm' THEN 'M ' || CASE num WHEN '' THEN '0' ELSE num END WHEN 'ngc' THEN 'NGC ' || CASE num WHEN '' THEN '0' ELSE num END WHEN 'sh2' THEN 'Sh2-' || CASE num WHEN '' THEN '0' ELSE num END WHEN 'vdb' THEN 'vdB ' || CASE num WHEN '' THEN '0' ELSE num END WHEN 'ic' THEN 'IC ' || CASE num WHEN '' THEN '0' ELSE num END ELSE t END AS name FROM x""")
def _(v):
    return v.exposures.selectExpr("event_id", f"{_NAMES} AS t").select("event_id", text.normalize_target(F.col("t")).alias("name"))


@query("B07_catalog_priority", f"WITH n AS (SELECT event_id, upper(trim({_NAMES})) AS t FROM {{exposures}}) SELECT event_id, CASE WHEN regexp_matches(t, '^M($|[\\s\\-_]*\\d)') THEN 1 WHEN regexp_matches(t, '^NGC($|[\\s\\-_]*\\d)') THEN 2 WHEN regexp_matches(t, '^IC($|[\\s\\-_]*\\d)') THEN 3 WHEN regexp_matches(t, '^SH2($|[\\s\\-_]*\\d)') THEN 5 WHEN regexp_matches(t, '^VDB($|[\\s\\-_]*\\d)') THEN 11 ELSE 99 END AS priority FROM n")
def _(v):
    return v.exposures.selectExpr("event_id", f"{_NAMES} AS t").select("event_id", text.catalog_priority(F.col("t")).alias("priority"))


@query("B13_image_type", "SELECT path, CASE WHEN image_type = 'DARKFLAT' AND path % 2 = 0 THEN 'DARKFLAT' ELSE image_type END AS image_type FROM {frames}")
def _(v):
    raw = F.when(F.col("image_type") == "DARKFLAT", F.when(F.col("path") % 2 == 0, "Dark Flat Frame").otherwise("master_darkflat")).when(F.col("path") % 3 == 0, F.concat(F.lower("image_type"), F.lit(" frame"))).otherwise(F.concat(F.lit("Master "), "image_type"))
    return v.frames.select("path", text.normalize_image_type(raw).alias("image_type"))


@query("B14_calibration_targets", f"SELECT event_id, lower({_NAMES}) LIKE '%dark%' AS calibration FROM {{exposures}}")
def _(v):
    return v.exposures.selectExpr("event_id", f"{_NAMES} AS t").select("event_id", text.is_calibration_target(F.col("t")).alias("calibration"))


@query("B18_sexagesimal", "SELECT id, CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END * (id % 90 + (id % 60) / 60 + (id % 50) / 3600) AS degrees FROM {targets}", "degrees")
def _(v):
    written = F.concat(F.when(F.col("id") % 2 == 0, "-").otherwise("+"), (F.col("id") % 90).cast("string"), F.lit(":"), (F.col("id") % 60).cast("string"), F.lit(":"), (F.col("id") % 50).cast("string"))
    return v.targets.select("id", text.sexagesimal_to_degrees(written).alias("degrees"))


@query("A04_target_from_path", "SELECT path, source AS target FROM {files}")
def _(v):
    night = F.when(F.col("file_id") % 2 == 0, F.concat(F.col("source"), F.lit("/Night_2"), F.expr("substr(path, length(source) + 1)"))).otherwise(F.col("path"))
    return v.files.select("path", text.target_from_path(F.concat(F.lit("/data/"), night)).alias("target"))


@query("B26_weather_class", "SELECT weather_id, CASE WHEN precipitation > 0.1 THEN 'Precipitation' WHEN cloud_cover < 10 THEN 'Clear' WHEN cloud_cover < 25 THEN 'Mostly Clear' WHEN cloud_cover < 50 THEN 'Partly Cloudy' WHEN cloud_cover < 75 THEN 'Mostly Cloudy' ELSE 'Overcast' END AS class FROM {weather}")
def _(v):
    return v.weather.select("weather_id", sky.classify_weather(F.col("cloud_cover"), F.col("precipitation")).alias("class"))


_MEASURES = ("cloud_cover", "wind_speed", "humidity", "temperature", "dewpoint")


@query("B27_seeing_quality", """WITH s AS (SELECT weather_id, cloud_cover, 100 - CASE WHEN cloud_cover > 25 THEN 30 WHEN cloud_cover > 10 THEN 10 ELSE 0 END - CASE WHEN wind_speed > 30 THEN 40 WHEN wind_speed > 20 THEN 25 WHEN wind_speed > 10 THEN 10 ELSE 0 END - CASE WHEN humidity > 90 THEN 30 WHEN humidity > 80 THEN 15 ELSE 0 END
 - CASE WHEN temperature - dewpoint < 2 THEN 25 WHEN temperature - dewpoint < 5 THEN 10 ELSE 0 END AS s FROM {weather}) SELECT weather_id, CASE WHEN cloud_cover > 50 THEN 'Poor' WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Good' WHEN s >= 40 THEN 'Fair' ELSE 'Poor' END AS seeing FROM s""")
def _(v):
    return v.weather.select("weather_id", sky.seeing_quality(*map(F.col, _MEASURES)).alias("seeing"))


@query("B28_imaging_score", """WITH s AS (SELECT weather_id, 100 - CASE WHEN cloud_cover > 75 THEN 60 WHEN cloud_cover > 50 THEN 40 WHEN cloud_cover > 25 THEN 20 WHEN cloud_cover > 10 THEN 5 ELSE 0 END - CASE WHEN wind_speed > 40 THEN 30 WHEN wind_speed > 25 THEN 20 WHEN wind_speed > 15 THEN 10 ELSE 0 END - CASE WHEN humidity > 95 THEN 20 WHEN humidity > 85 THEN 10 ELSE 0 END
 - CASE WHEN temperature - dewpoint < 2 THEN 15 WHEN temperature - dewpoint < 4 THEN 5 ELSE 0 END AS s FROM {weather}) SELECT weather_id, CAST(greatest(0, least(100, trunc(s * (0.5 + 0.5 * ((weather_id % 10) / 10.0))))) AS INT) AS score FROM s""")
def _(v):
    return v.weather.select("weather_id", sky.imaging_score(*map(F.col, _MEASURES), (F.col("weather_id") % 10) / 10.0).alias("score"))


@query("B30_quality_score", """SELECT frame, star, greatest(0, least(100, (fwhm - 8) / -6 * 100)) * 0.35 + greatest(0, least(100, (eccentricity - 0.8) / -0.5 * 100)) * 0.2 + greatest(0, least(100, (snr - 5) / 45 * 100)) * 0.2 + greatest(0, least(100, (snr - 5) / 95 * 100)) * 0.15
 + greatest(0, least(100, (1 - eccentricity - 0.3) / 0.5 * 100)) * 0.1 AS score FROM {stars}""", "score")
def _(v):
    measures = {"fwhm": F.col("fwhm"), "eccentricity": F.col("eccentricity"), "snr": F.col("snr"), "stars": F.col("snr"), "roundness": 1 - F.col("eccentricity")}
    return v.stars.select("frame", "star", sky.quality_score(measures).alias("score"))


@query("B31_tracking_grade", "WITH t AS (SELECT session_id, sqrt(avg(ra_stdev * ra_stdev)) AS r FROM {mount_samples} WHERE status = 'TRACKING' GROUP BY session_id) SELECT session_id, CASE WHEN r < 0.5 THEN 'A' WHEN r < 1 THEN 'B' WHEN r < 2 THEN 'C' WHEN r < 5 THEN 'D' ELSE 'F' END AS grade FROM t")
def _(v):
    return stats.tracking_stats(v.mount_samples).where("n_tracking > 0").select("session_id", sky.tracking_grade(F.col("rms_ra")).alias("grade"))


@query("B20_gnomonic", """WITH c AS (SELECT id, radians(ra_deg) AS a, radians(dec_deg) AS d, radians(180.0) AS a0, radians(10.0) AS d0 FROM {targets}), k AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a - a0) AS c FROM c)
 SELECT id, CASE WHEN c > 0.1 THEN degrees(cos(d) * sin(a - a0) / c) END AS x, CASE WHEN c > 0.1 THEN degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a - a0)) / c) END AS y FROM k WHERE c > 0.1""", "x y")
def _(v):
    x, y = sky.gnomonic(F.col("ra_deg"), F.col("dec_deg"), F.lit(180.0), F.lit(10.0))
    near = F.cos(F.radians(joins.angular_distance(F.col("ra_deg"), F.col("dec_deg"), F.lit(180.0), F.lit(10.0)))) > 0.1
    return v.targets.where(near).select("id", x.alias("x"), y.alias("y"))


@query("B34_durations", "SELECT target_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS STRING) || 'h ' || lpad(CAST(s % 3600 // 60 AS STRING), 2, '0') || 'm' ELSE CAST(s // 60 AS STRING) || 'm' END AS total FROM (SELECT target_id, CAST(sum(exposure_time) AS BIGINT) AS s FROM {observations} GROUP BY target_id)")
def _(v):
    return v.observations.groupBy("target_id").agg(F.sum("exposure_time").cast("long").alias("s")).select("target_id", text.format_duration(F.col("s")).alias("total"))


_EXPOSURE_PARTS = "b AS (SELECT event_id, timestamp, file_path, hfr FROM {exposures} WHERE event_id % 2 = 0), n AS (SELECT event_id, timestamp, file_path, hfr + 1 AS hfr FROM {exposures} WHERE event_id % 3 = 0)"


@query("I01_insert_ignore", f"WITH {_EXPOSURE_PARTS} SELECT * FROM b UNION ALL SELECT * FROM n WHERE file_path IS NULL OR (timestamp, file_path) NOT IN (SELECT (timestamp, file_path) FROM b WHERE file_path IS NOT NULL)", "hfr")
def _(v):
    rows = v.exposures.select("event_id", "timestamp", "file_path", "hfr")
    return upserts.insert_ignore(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0").withColumn("hfr", F.col("hfr") + 1), ["timestamp", "file_path"], "event_id")


_OBSERVED = "o AS (SELECT seq, target_id, observation_date, coalesce(filter, '') AS f, coalesce(telescope, '') AS t, filter, telescope, exposure_time FROM {observations})"


@query("I02_upsert_replace", f"WITH {_OBSERVED}, n AS (SELECT * FROM o WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY target_id, f, t ORDER BY seq DESC) = 1), b AS (SELECT * FROM o WHERE seq % 3 <> 0) SELECT seq, target_id, filter, telescope, exposure_time FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.target_id = b.target_id AND n.f = b.f AND n.t = b.t) UNION ALL SELECT seq, target_id, filter, telescope, exposure_time FROM n")
def _(v):
    rows = v.observations.select("seq", "target_id", "filter", "telescope", "exposure_time")
    return upserts.upsert_replace(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0"), ["target_id", "filter", "telescope"], "seq")


@query("I03_upsert_targets", "WITH n AS (SELECT id + 100 AS id, CASE WHEN id % 2 = 0 THEN name END AS name, object_type FROM {targets}) SELECT coalesce(n.id, t.id) AS id, coalesce(n.name, t.name) AS name, coalesce(n.object_type, t.object_type) AS object_type FROM {targets} t FULL JOIN n ON t.id = n.id")
def _(v):
    base = v.targets.select("id", "name", "object_type")
    return upserts.upsert_targets(base, base.select((F.col("id") + 100).alias("id"), F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"), "object_type"), "id")


@query("I05_delete_cascade", "SELECT seq FROM {observations} WHERE target_id NOT IN (SELECT id FROM {targets} WHERE priority > 25)")
def _(v):
    return upserts.delete_cascade(v.targets, v.observations, "priority > 25", "id", "target_id")[1].select("seq")


@query("F06_merge_targets", "SELECT CASE WHEN target_id = 7 THEN 3 ELSE target_id END AS target_id, sum(exposure_time) AS total_exposure, CAST(sum(frame_count) AS BIGINT) AS total_frames, min(observation_date) AS first_date, max(observation_date) AS last_date FROM {observations} GROUP BY 1")
def _(v):
    return stats.target_totals(upserts.merge_targets(v.observations, 7, 3))


_MERGES = "SELECT id AS source, CASE id % 10 WHEN 9 THEN id + 10000000000 WHEN 7 THEN id ELSE id - 1 END AS dest FROM {targets} WHERE id % 10 IN (3, 4, 7, 9)"


def _merges(v):
    return v.targets.where("id % 10 in (3, 4, 7, 9)").selectExpr("id AS source", "CASE id % 10 WHEN 9 THEN id + 10000000000 WHEN 7 THEN id ELSE id - 1 END AS dest")


@query("F06_merge_plan", f"""WITH m AS ({_MERGES}), s AS (SELECT target_id, sum(exposure_time) AS e, sum(frame_count) AS f, count(*) AS n FROM {{observations}} GROUP BY target_id), t AS (SELECT id, name, coalesce(e, 0) AS e, CAST(coalesce(f, 0) AS BIGINT) AS f, coalesce(n, 0) AS n FROM {{targets}} LEFT JOIN s ON target_id = id)
 SELECT source, a.name AS source_name, CAST(a.e AS DOUBLE) AS source_exposure, a.f AS source_frames, dest, b.name AS dest_name, CAST(b.e AS DOUBLE) AS dest_exposure, b.f AS dest_frames, CASE WHEN b.id IS NULL OR source = dest THEN 0 ELSE a.n END AS observations_moved, CASE WHEN b.id IS NULL THEN 'dest not found' WHEN source = dest THEN 'same target' END AS problem
 FROM m LEFT JOIN t a ON a.id = source LEFT JOIN t b ON b.id = dest""")
def _(v):
    return cluster.merge_plan(v.targets, v.observations, _merges(v))


_KEPT = "CASE WHEN {c} % 10 IN (3, 4) THEN {c} - {c} % 10 + 2 ELSE {c} END"


@query("F06_merge_pairs", f"""WITH o AS (SELECT {_KEPT.format(c='target_id')} AS id, exposure_time, frame_count, observation_date FROM {{observations}}), s AS (SELECT id, sum(exposure_time) AS e, sum(frame_count) AS f, min(observation_date) AS a, max(observation_date) AS z FROM o GROUP BY id)
 SELECT t.id, t.name, CAST(coalesce(e, 0) AS DOUBLE) AS total_exposure, CAST(coalesce(f, 0) AS BIGINT) AS total_frames, a AS first_date, z AS last_date FROM {{targets}} t LEFT JOIN s ON s.id = t.id WHERE t.id % 10 NOT IN (3, 4)""")
def _(v):
    return cluster.merge_pairs(v.targets.select("id", "name"), v.observations, _merges(v))[0].withColumn("total_exposure", F.col("total_exposure").cast("double"))


_PAIRS = "degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(b.dec_deg - a.dec_deg) / 2), 2) + cos(radians(a.dec_deg)) * cos(radians(b.dec_deg)) * pow(sin(radians(b.ra_deg - a.ra_deg) / 2), 2)))))"


@query("F01_cluster_targets", f"""WITH RECURSIVE e AS (SELECT a.id AS u, b.id AS v FROM {{targets}} a JOIN {{targets}} b ON a.id <> b.id AND abs(a.dec_deg - b.dec_deg) <= 1.5 WHERE {_PAIRS} <= 1.5),
 r AS (SELECT id, id AS c FROM {{targets}} UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v) SELECT id, min(c) AS cluster, true AS core FROM r GROUP BY id""")
def _(v):
    return cluster.cluster_targets(v.targets, 1.5, 1)


@query("F07_merge_duplicates", "SELECT id, min(id) OVER (PARTITION BY canonical_name) AS keep FROM {targets}")
def _(v):
    return cluster.merge_duplicates(v.targets)


# names and canonical names that every one of the three rules meets
_ALIASED = {"name": "CASE id % 6 WHEN 0 THEN replace(canonical_name, ' ', '  ') WHEN 1 THEN 'x' || CAST(floor(id / 12) AS INT) || ' (455mm)' WHEN 2 THEN 'x' || CAST(floor(id / 12) AS INT) WHEN 3 THEN 'y' || id || ' (80MM)' ELSE name END",
            "canonical_name": "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 3 THEN NULL ELSE canonical_name END"}


@query("F07_merge_passes", f"""WITH RECURSIVE t AS (SELECT id, {_ALIASED['name']} AS name, {_ALIASED['canonical_name']} AS canonical_name, object_type FROM {{targets}}),
 s AS (SELECT id AS u, min(id) OVER (PARTITION BY canonical_name) AS v FROM t WHERE canonical_name <> '' UNION SELECT id, min(id) OVER (PARTITION BY regexp_replace(name, ' [(][0-9]+mm[)]$', '', 'i')) FROM t UNION SELECT o.id, k.v FROM t o JOIN (SELECT canonical_name AS c, min(id) AS v FROM t WHERE canonical_name <> '' GROUP BY 1) k ON k.c = replace(o.name, '  ', ' ') WHERE coalesce(o.canonical_name, '') = ''),
 e AS (SELECT u, v FROM s WHERE u <> v UNION SELECT v, u FROM s WHERE u <> v), r AS (SELECT id, id AS c FROM t UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v), k AS (SELECT id, min(c) AS keep FROM r GROUP BY id),
 g AS (SELECT keep, count(*) - 1 AS n_merged, arg_min(canonical_name, id) FILTER (canonical_name <> '') AS c, arg_min(object_type, id) FILTER (object_type IS NOT NULL) AS o FROM k JOIN t USING (id) GROUP BY keep), x AS (SELECT keep, sum(exposure_time) AS e, count(*) AS n FROM {{observations}} JOIN k ON id = target_id GROUP BY keep)
 SELECT t.id, name, coalesce(nullif(canonical_name, ''), c) AS canonical_name, CASE WHEN coalesce(canonical_name, '') = '' THEN coalesce(object_type, o) ELSE object_type END AS object_type, n_merged, CAST(coalesce(e, 0) AS DOUBLE) AS exposure, coalesce(n, 0) AS n_observations FROM t JOIN g ON g.keep = t.id LEFT JOIN x ON x.keep = t.id""")
def _(v):
    targets = v.targets.selectExpr("id", *(f"{e} AS {c}" for c, e in _ALIASED.items()), "object_type")
    kept, moved = cluster.merged_tables(targets, v.observations, cluster.merge_duplicates(targets))
    sums = moved.groupBy(F.col("target_id").alias("id")).agg(F.sum("exposure_time").cast("double").alias("e"), F.count("*").alias("n"))
    return kept.join(sums, "id", "left").select(*kept.columns, F.coalesce("e", F.lit(0.0)).alias("exposure"), F.coalesce("n", F.lit(0)).cast("long").alias("n_observations"))


@query("G07_welch", """WITH g AS (SELECT camera, count(*) AS n, avg(hfr) AS m, var_samp(hfr) AS s FROM {exposures} GROUP BY camera) SELECT a.n AS n_a, b.n AS n_b, (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t, pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) AS df,
 (a.m - b.m) / sqrt((a.s + b.s) / 2) AS cohen_d FROM g a JOIN g b ON a.camera = 'C0' AND b.camera = 'C1'""", "t df cohen_d")
def _(v):
    of = lambda c: F.when(F.col("camera") == c, F.col("hfr"))
    parts = [f(of(c)).alias(f"{n}_{s}") for c, s in (("C0", "a"), ("C1", "b")) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))]
    g = v.exposures.agg(*parts)
    ea, eb = F.col("s_a") / F.col("n_a"), F.col("s_b") / F.col("n_b")
    return g.select("n_a", "n_b", ((F.col("m_a") - F.col("m_b")) / F.sqrt(ea + eb)).alias("t"), (F.pow(ea + eb, F.lit(2)) / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))).alias("df"), ((F.col("m_a") - F.col("m_b")) / F.sqrt((F.col("s_a") + F.col("s_b")) / 2)).alias("cohen_d"))
