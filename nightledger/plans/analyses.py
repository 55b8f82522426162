"""Registered queries over processing logs, mounts, nights and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import ordered, processing
from .catalog import _SEGMENTS, query

_QUALITY = "count(*) AS n, nullif(avg(fwhm), 0) AS avg_fwhm, nullif(avg(eccentricity), 0) AS avg_eccentricity, nullif(avg(snr), 0) AS avg_snr, nullif(avg(num_stars), 0) AS avg_num_stars, nullif(avg(median_adu), 0) AS avg_median_adu, min(fwhm) AS min_fwhm, max(fwhm) AS max_fwhm, min(snr) AS min_snr, max(snr) AS max_snr"
_ROUNDED = "avg_fwhm avg_eccentricity avg_snr avg_num_stars avg_median_adu min_fwhm max_fwhm min_snr max_snr"

for _name, _keys in (("filter", ["session_id", "filter_name"]), ("target", ["target"]), ("camera", ["camera", "filter_name"])):

    @query(f"D21_quality_by_{_name}", f"WITH s AS (SELECT * REPLACE (coalesce(filter_name, 'Unknown') AS filter_name) FROM {{subframes}}) SELECT {', '.join(_keys)}, {_QUALITY} FROM s GROUP BY {', '.join(_keys)}", _ROUNDED)
    def _(v, keys=_keys):
        named = v.subframes.withColumn("filter_name", F.coalesce("filter_name", F.lit("Unknown")))
        return processing.subframe_quality(named.withColumn("session_id", F.col("session_id").cast("string")), keys).withColumns({k: F.col(k).cast("long") for k in keys if k == "session_id"})


@query("C05_quality_trends", """WITH q AS (SELECT session_id, nullif(avg(fwhm), 0) AS avg_fwhm, nullif(avg(eccentricity), 0) AS avg_eccentricity, nullif(avg(snr), 0) AS avg_snr, count(*) AS frame_count FROM {subframes} GROUP BY session_id), l AS (SELECT session_id, max(log_date) AS log_date FROM {log_sessions} GROUP BY session_id)
 SELECT q.*, log_date FROM q LEFT JOIN l ON l.session_id = q.session_id ORDER BY log_date NULLS FIRST, q.session_id LIMIT 50""", "avg_fwhm avg_eccentricity avg_snr")
def _(v):
    return processing.quality_trends(v.subframes, v.log_sessions)


@query("C06_integration_with_weights", """WITH w AS (SELECT integration_id, array_to_string(list(filename ORDER BY normalized_weight DESC NULLS LAST, filename DESC), ';') AS frames, count(*) AS n FROM {weights} GROUP BY integration_id) SELECT i.integration_id, i.filter_name, frames, n FROM {integrations} i LEFT JOIN w ON w.integration_id = i.integration_id""")
def _(v):
    found = processing.integration_with_weights(v.integrations, v.weights)
    return found.select("integration_id", "filter_name", F.array_join("frames.filename", ";").alias("frames"), F.when(F.col("frames").isNotNull(), F.size("frames")).cast("long").alias("n"))


@query("C07_attach_by_basename", """WITH r AS (SELECT l_orderkey AS integration_id, 'L_' || l_orderkey || '_' || l_linenumber || '.xisf' AS base, min(l_extendedprice) AS pixel_rejection FROM lineitem GROUP BY ALL), w AS (SELECT *, list_extract(string_split(filename, '/'), -1) AS base FROM {weights})
 SELECT w.integration_id, w.filename, w.normalized_weight, r.pixel_rejection FROM w LEFT JOIN r ON r.integration_id = w.integration_id AND r.base = w.base""", "pixel_rejection normalized_weight")
def _(v):
    other = v.lineitem.selectExpr("l_orderkey AS integration_id", "'/tmp/x/L_' || l_orderkey || '_' || l_linenumber || '.xisf' AS filename", "l_extendedprice AS pixel_rejection")
    return processing.attach_by_basename(v.weights, other, ["pixel_rejection"]).select("integration_id", "filename", "normalized_weight", "pixel_rejection")


@query("C15_orphan_matches", """WITH t AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN NULL ELSE canonical_name END AS canonical_name, replace(canonical_name, ' ', '  ') AS other FROM {targets}) SELECT a.id AS orphan_id, b.id AS match_id FROM t a JOIN t b ON a.id <> b.id AND b.canonical_name IS NOT NULL AND regexp_replace(a.other, ' +', ' ', 'g') = regexp_replace(b.canonical_name, ' +', ' ', 'g') WHERE a.canonical_name IS NULL""")
def _(v):
    t = v.targets.select("id", F.replace("canonical_name", F.lit(" "), F.lit("  ")).alias("name"), F.when(F.col("id") % 3 != 0, F.col("canonical_name")).alias("canonical_name"))
    return ordered.orphan_matches(t)


@query("D19_segment_stats", f"""WITH {_SEGMENTS}, m AS (SELECT session_id, segment, quantile_cont(ra_hours, 0.5) AS ra, quantile_cont(dec_degrees, 0.5) AS de FROM g WHERE status = 'TRACKING' GROUP BY session_id, segment),
 d AS (SELECT g.*, (ra_hours - ra) * 54000 * greatest(cos(radians(de)), 0.01) AS ro, (dec_degrees - de) * 3600 AS dd FROM g LEFT JOIN m ON g.session_id = m.session_id AND g.segment = m.segment)
 SELECT session_id, segment, count(*) AS total_samples, count(*) FILTER (status = 'TRACKING') AS tracking_samples, avg(ra_hours) FILTER (status = 'TRACKING') AS avg_ra_hours, avg(dec_degrees) FILTER (status = 'TRACKING') AS avg_dec_degrees, avg(ra_stdev) FILTER (status = 'TRACKING') AS ra_stdev_mean, avg(dec_stdev) FILTER (status = 'TRACKING') AS dec_stdev_mean,
 sqrt(nullif(avg(ro * ro) FILTER (status = 'TRACKING'), 0)) AS ra_rms, sqrt(nullif(avg(dd * dd) FILTER (status = 'TRACKING'), 0)) AS dec_rms, coalesce(max(ro) FILTER (status = 'TRACKING'), 0) - coalesce(min(ro) FILTER (status = 'TRACKING'), 0) AS ra_range, coalesce(max(dd) FILTER (status = 'TRACKING'), 0) - coalesce(min(dd) FILTER (status = 'TRACKING'), 0) AS dec_range, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM d GROUP BY session_id, segment""", "avg_ra_hours avg_dec_degrees ra_stdev_mean dec_stdev_mean ra_rms dec_rms ra_range dec_range")
def _(v):
    return processing.segment_stats(ordered.deviations(ordered.segment_jumps(v.mount_samples)))


@query("D20_time_stability", "SELECT user_id AS session_id, count(*) AS samples, avg(value - 50) AS pc_mount_diff_mean, stddev_samp(value - 50) AS pc_mount_diff_stdev, avg(value / 7) AS pc_loop_mean, max(value / 7) AS pc_loop_max, avg(value / 9) AS mount_loop_mean, max(value / 9) AS mount_loop_max FROM events GROUP BY user_id", "pc_mount_diff_mean pc_mount_diff_stdev pc_loop_mean pc_loop_max mount_loop_mean mount_loop_max")
def _(v):
    return processing.time_stability(v.events.selectExpr("user_id AS session_id", "value - 50 AS pc_mount_diff_ms", "value / 7 AS pc_loop_ms", "value / 9 AS mount_loop_ms"))


@query("D22_rejection_stats", """SELECT session_id, count(*) AS total_frames, count(*) FILTER (accepted) AS accepted_count, count(*) FILTER (NOT accepted) AS rejected_count, count(*) FILTER (accepted) * 100.0 / count(*) AS acceptance_rate, nullif(avg(normalized_weight) FILTER (accepted), 0) AS avg_weight_accepted, nullif(avg(normalized_weight) FILTER (NOT accepted), 0) AS avg_weight_rejected FROM {weights} GROUP BY session_id""", "acceptance_rate avg_weight_accepted avg_weight_rejected")
def _(v):
    return processing.rejection_stats(v.weights)


@query("D22_rejected_frames", "SELECT session_id, filename, normalized_weight FROM {weights} WHERE NOT accepted", "normalized_weight")
def _(v):
    return processing.rejected_frames(v.weights)


@query("D23_filter_efficiency", "SELECT filter_name, CAST(sum(frames_total) AS BIGINT) AS total_frames, CAST(sum(frames_integrated) AS BIGINT) AS total_integrated, CAST(sum(frames_total - frames_integrated) AS BIGINT) AS total_rejected, nullif(avg(total_rejection_pct), 0) AS avg_pixel_rejection_pct, sum(frames_total - frames_integrated) * 100.0 / sum(frames_total) AS rejection_rate FROM {integrations} WHERE filter_name IS NOT NULL GROUP BY filter_name", "avg_pixel_rejection_pct rejection_rate")
def _(v):
    return processing.filter_efficiency(v.integrations)


@query("D24_processing_summary", """WITH l AS (SELECT * FROM {log_sessions} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY row_id DESC) = 1) SELECT l.session_id, tool_version, subframes_ok, (SELECT count(*) FROM {integrations} i WHERE i.session_id = l.session_id) AS integration_count, (SELECT count(*) FROM {frames} f WHERE f.image_type <> 'LIGHT' AND f.path % 60 = l.session_id) AS calibration_count FROM l""")
def _(v):
    groups = v.frames.where("image_type <> 'LIGHT'").selectExpr("path % 60 AS session_id")
    return processing.processing_summary(v.log_sessions, v.integrations, groups).select("session_id", "tool_version", "subframes_ok", "integration_count", "calibration_count")


@query("D25_seeing_estimate", "SELECT session_id, avg(fwhm) AS avg_fwhm_px, min(fwhm) AS min_fwhm_px, max(fwhm) AS max_fwhm_px, avg(fwhm) * 0.77 AS avg_seeing_arcsec, min(fwhm) * 0.77 AS min_seeing_arcsec, max(fwhm) * 0.77 AS max_seeing_arcsec FROM {subframes} WHERE fwhm IS NOT NULL GROUP BY session_id", "avg_fwhm_px min_fwhm_px max_fwhm_px avg_seeing_arcsec min_seeing_arcsec max_seeing_arcsec")
def _(v):
    return processing.seeing_estimate(v.subframes, 0.77)


@query("D26_calibration_summary", "SELECT path % 60 AS session_id, image_type AS frame_type, filter AS filter_name, path FROM {frames} WHERE image_type <> 'LIGHT' AND path % 60 = 3")
def _(v):
    return processing.calibration_summary(v.frames.where("image_type <> 'LIGHT'").selectExpr("path % 60 AS session_id", "image_type AS frame_type", "filter AS filter_name", "path"), 3)


_DARK = """d AS (SELECT DISTINCT session_date FROM {exposures}), s AS (SELECT session_date, unnest(range(0, 144)) AS k FROM d), j AS (SELECT session_date, date_diff('day', DATE '2000-01-01', session_date) + k / 144.0 AS n FROM s),
 sun AS (SELECT session_date, n, radians(280.460 + 0.9856474 * n) + radians(1.915 * sin(radians(357.528 + 0.9856003 * n)) + 0.020 * sin(2 * radians(357.528 + 0.9856003 * n))) AS lam FROM j),
 alt AS (SELECT session_date, degrees(asin(sin(radians(48.0)) * sin(radians(23.439)) * sin(lam) + cos(radians(48.0)) * cos(asin(sin(radians(23.439)) * sin(lam))) * cos(radians(280.46061837 + 360.98564736629 * n + 5.0) - atan2(cos(radians(23.439)) * sin(lam), cos(lam))))) AS a FROM sun),
 dark AS (SELECT session_date, CAST(count(*) FILTER (a < -18) AS BIGINT) AS dark_samples, round(count(*) FILTER (a < -18) / 6.0, 2) AS dark_hours FROM alt GROUP BY session_date)"""


def _dark(v):
    return sky.dark_hours(v.exposures.select("session_date").distinct(), "session_date", 48.0, 5.0)


@query("G05_dark_hours", f"WITH {_DARK} SELECT * FROM dark", "dark_hours")
def _(v):
    return _dark(v)


_EFFICIENCY = f"""{_DARK}, x AS (SELECT session_date, sum(CASE WHEN extract(day FROM session_date) % 3 = 0 THEN 0 ELSE exposure_seconds END) AS a FROM {{exposures}} GROUP BY session_date), o AS (SELECT observation_date, sum(exposure_time) AS b FROM {{observations}} GROUP BY observation_date),
 e AS (SELECT dark.session_date, dark_hours, coalesce(nullif(a, 0), b, 0) / 3600 AS integration_hours, least(100, coalesce(nullif(a, 0), b, 0) / (dark_hours * 3600) * 100) AS efficiency_pct FROM dark LEFT JOIN x ON x.session_date = dark.session_date LEFT JOIN o ON o.observation_date = dark.session_date WHERE dark_hours > 0)"""


def _efficiency(v):
    seconds = F.when(F.dayofmonth("session_date") % 3 == 0, 0.0).otherwise(F.col("exposure_seconds"))  # nights without seconds, so that observations stand in
    return processing.imaging_efficiency(_dark(v).select("session_date", "dark_hours"), v.exposures.withColumn("exposure_seconds", seconds), v.observations)


@query("G06_imaging_efficiency", f"WITH {_EFFICIENCY} SELECT * FROM e", "integration_hours efficiency_pct")
def _(v):
    return _efficiency(v)


@query("D42_efficiency_overview", f"WITH {_EFFICIENCY} SELECT avg(efficiency_pct) FILTER (efficiency_pct > 0) AS mean_efficiency, arg_max(session_date, (efficiency_pct, -date_diff('day', DATE '1970-01-01', session_date))) AS best_night, max(efficiency_pct) AS best_efficiency, sum(dark_hours) AS total_dark, sum(integration_hours) AS total_integration FROM e", "mean_efficiency best_efficiency total_dark total_integration")
def _(v):
    return processing.efficiency_overview(_efficiency(v))


@query("D44_weather_at", """WITH w AS (SELECT weather_id, timestamp, CAST(timestamp AS DATE) AS day, telescope, hour(timestamp) AS h, row_number() OVER (PARTITION BY CAST(timestamp AS DATE), telescope ORDER BY timestamp) - 1 AS p FROM {weather} QUALIFY row_number() OVER (PARTITION BY telescope, CAST(timestamp AS DATE), hour(timestamp), minute(timestamp), second(timestamp) ORDER BY weather_id) = 1),
 r AS (SELECT *, coalesce(nullif(list_position([3, 22, 23, 0, 1, 2, 21, 20], h), 0), CASE WHEN p <= 3 THEN 10000 - p ELSE 99999 END) AS k FROM w) SELECT telescope, day, timestamp, CAST(h AS INT) AS hour FROM r QUALIFY row_number() OVER (PARTITION BY telescope, day ORDER BY k, timestamp) = 1""")
def _(v):
    one = v.weather.groupBy("telescope", F.to_date("timestamp").alias("day"), "timestamp").agg(F.min("weather_id").alias("weather_id"))
    return processing.weather_at(one, "day", ["telescope"], 3).select("telescope", "day", "timestamp", F.hour("timestamp").alias("hour"))


@query("A26_explode_hourly", """SELECT p_partkey AS id, '2024-01-01T' || lpad(CAST(k AS STRING), 2, '0') || ':00' AS time, CAST(p_size + k AS DOUBLE) AS temperature, CASE WHEN k < 2 THEN CAST(k * 10 AS DOUBLE) END AS cloud FROM part, (SELECT unnest(range(0, 3)) AS k)""")
def _(v):
    j = v.part.selectExpr("p_partkey AS id", """'{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "temperature": [' || p_size || ', ' || (p_size + 1) || ', ' || (p_size + 2) || '], "cloud": [0, 10]}}' AS body""")
    return processing.explode_hourly(j, "body", ("temperature", "cloud")).drop("body")


_PHI = "radians(48.0)"


@query("B29_visibility", f"""WITH t AS (SELECT id, CAST(ra_deg AS DOUBLE) AS ra, CAST(dec_deg AS DOUBLE) AS de FROM {{targets}}), c AS (SELECT id, ra, degrees(asin(greatest(-1, least(1, sin({_PHI}) * sin(radians(de)) + cos({_PHI}) * cos(radians(de)))))) AS high, (sin(radians(20.0)) - sin({_PHI}) * sin(radians(de))) / (cos({_PHI}) * cos(radians(de))) AS co,
 (date_diff('day', DATE '2000-01-01', DATE '2024-03-05') - 0.5) / 36525.0 AS tc FROM t) SELECT id, round(high, 1) AS max_altitude, CASE WHEN abs(co) > 1 AND high > 20 THEN 24.0 WHEN abs(co) > 1 THEN 0.0 ELSE round(2 * degrees(acos(CASE WHEN abs(co) <= 1 THEN co END)) / 15, 1) END AS hours_above_min, abs(co) > 1 AND high > 20 AS is_circumpolar, abs(co) > 1 AND high <= 20 AS never_rises FROM c""", "hours_above_min max_altitude")
def _(v):
    found = sky.visibility(F.col("ra_deg").cast("double"), F.col("dec_deg").cast("double"), 48.0, 5.0, F.lit("2024-03-05").cast("date"))
    return v.targets.select("id", *(found[c].alias(c) for c in ("max_altitude", "hours_above_min", "is_circumpolar", "never_rises")))


@query("D43_night_weather", """WITH n AS (SELECT CAST(timestamp - INTERVAL 6 HOUR AS DATE) AS night, * FROM {weather} WHERE hour(timestamp) >= 20 OR hour(timestamp) < 6) SELECT night, avg(temperature) AS temperature, avg(cloud_cover) AS cloud, min(cloud_cover) AS cloud_min, max(cloud_cover) AS cloud_max, max(weather_id % 101) AS precipitation_prob, sum(precipitation) AS precipitation, avg(wind_speed) AS wind, avg(humidity) AS humidity, avg(dewpoint) AS dewpoint,
 count(*) FILTER (cloud_cover < 25) AS clear_hours, count(cloud_cover) AS total_hours, CASE WHEN avg(precipitation) > 0.1 THEN 'Precipitation' WHEN avg(cloud_cover) < 10 THEN 'Clear' WHEN avg(cloud_cover) < 25 THEN 'Mostly Clear' WHEN avg(cloud_cover) < 50 THEN 'Partly Cloudy' WHEN avg(cloud_cover) < 75 THEN 'Mostly Cloudy' ELSE 'Overcast' END AS classification FROM n GROUP BY night HAVING count(cloud_cover) > 0""", "temperature cloud precipitation wind humidity dewpoint")
def _(v):
    rows = v.weather.withColumn("precipitation_probability", F.col("weather_id") % 101)
    return ordered.night_weather(rows).drop("seeing_quality", "imaging_score")
