"""The registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, ordered, stats
from ..operators.selection import numbered
from .views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, rounds: str = ""):
    """Registers ``f(views)``; the double columns named in ``rounds`` are compared to six places."""
    columns = rounds.split()

    def add(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Views(spark, sf_dir))
            return found.withColumns({c: F.round(c, 6) for c in columns}) if columns else found

        QUERIES[name] = run
        if oracle:
            body = sql(oracle)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({body})" if columns else body
        return f

    return add


_BREAKDOWN = """count(*) AS n, sum(exposure_time) AS total_exposure, CAST(sum(frame_count) AS BIGINT) AS total_frames, count(DISTINCT observation_date) AS nights,
 sum(exposure_time) / nullif(sum(frame_count), 0) AS avg_sub, min(CASE WHEN hfr > 0 THEN hfr END) AS best_hfr, avg(CASE WHEN hfr > 0 THEN hfr END) AS avg_hfr, avg(CASE WHEN fwhm > 0 THEN fwhm END) AS avg_fwhm"""
_B = "avg_sub best_hfr avg_hfr avg_fwhm"


@query("D01_global_stats", """SELECT (SELECT count(*) FROM {targets}) AS n_targets, count(*) AS n_observations, sum(exposure_time) AS total_exposure, CAST(sum(frame_count) AS BIGINT) AS total_frames,
 count(DISTINCT observation_date) AS n_nights, count(DISTINCT filter) AS n_filters, count(DISTINCT nullif(telescope, '')) AS n_telescopes, count(DISTINCT nullif(camera, '')) AS n_cameras, min(observation_date) AS first_date, max(observation_date) AS last_date,
 avg(CASE WHEN hfr > 0 THEN hfr END) AS avg_hfr, avg(CASE WHEN fwhm > 0 THEN fwhm END) AS avg_fwhm FROM {observations}""", "avg_hfr avg_fwhm")
def _(v):
    return stats.global_stats(v.targets, v.observations)


@query("D02_target_totals", "SELECT target_id, sum(exposure_time) AS total_exposure, CAST(sum(frame_count) AS BIGINT) AS total_frames, min(observation_date) AS first_date, max(observation_date) AS last_date FROM {observations} GROUP BY target_id")
def _(v):
    return stats.target_totals(v.observations)


@query("D03_target_rankings", """SELECT t.id, t.name, coalesce(sum(o.exposure_time), 0) AS total_exposure, CAST(coalesce(sum(o.frame_count), 0) AS BIGINT) AS total_frames, count(DISTINCT o.observation_date) AS nights, count(DISTINCT o.filter) AS filters,
 coalesce(array_to_string(list_sort(list_distinct(list(o.telescope))), ','), '') AS telescopes FROM {targets} t LEFT JOIN {observations} o ON t.id = o.target_id GROUP BY t.id, t.name ORDER BY total_exposure DESC, t.id LIMIT 25""")
def _(v):
    return stats.target_rankings(v.targets, v.observations, 25)


@query("D04_filter_breakdown", f"SELECT target_id, filter, {_BREAKDOWN} FROM {{observations}} GROUP BY target_id, filter", _B)
def _(v):
    return stats.breakdown(v.observations, "target_id", "filter")


@query("D05_equipment_breakdown", f"SELECT target_id, telescope, camera, {_BREAKDOWN} FROM {{observations}} GROUP BY target_id, telescope, camera", _B)
def _(v):
    return stats.breakdown(v.observations, "target_id", "telescope", "camera")


@query("D06_monthly_timeline", f"SELECT target_id, strftime(observation_date, '%Y-%m') AS month, {_BREAKDOWN} FROM {{observations}} GROUP BY target_id, month", _B)
def _(v):
    return stats.breakdown(v.observations, "target_id", F.date_format("observation_date", "yyyy-MM").alias("month"))


@query("D07_filter_stats", f"SELECT filter, {_BREAKDOWN} FROM {{observations}} GROUP BY filter", _B)
def _(v):
    return stats.breakdown(v.observations, "filter")


for _name, _keys in (("telescope", ["telescope"]), ("camera", ["camera"]), ("setup", ["telescope", "camera"])):

    @query(f"D08_{_name}_stats", f"SELECT {', '.join(_keys)}, {_BREAKDOWN} FROM {{observations}} WHERE {' AND '.join(f'''coalesce(trim({k}), '') <> \'\'''' for k in _keys)} GROUP BY {', '.join(_keys)}", _B)
    def _(v, keys=tuple(_keys)):
        return stats.equipment_stats(v.observations, *keys)


for _name, _format in (("month", "%Y-%m"), ("year", "%Y")):

    @query(f"D09_{_name}_stats", f"SELECT strftime(observation_date, '{_format}') AS period, sum(exposure_time) AS total_exposure, CAST(sum(frame_count) AS BIGINT) AS total_frames, count(DISTINCT observation_date) AS nights, count(DISTINCT target_id) AS targets FROM {{observations}} GROUP BY period")
    def _(v, period=_name):
        return stats.period_stats(v.observations, period)


@query("D10_dow_stats", "SELECT CAST(dayofweek(observation_date) AS INT) AS dow, count(*) AS n, sum(exposure_time) AS total_exposure FROM {observations} GROUP BY dow")
def _(v):
    return stats.dow_stats(v.observations)


@query("D11_activity_calendar", "SELECT observation_date, sum(exposure_time) / 3600 AS hours FROM {observations} WHERE year(observation_date) = 1997 GROUP BY observation_date", "hours")
def _(v):
    return stats.activity_calendar(v.observations, 1997)


@query("D12_quality_trend", "SELECT strftime(observation_date, '%Y-%m') AS month, avg(hfr) AS avg_hfr, avg(CASE WHEN fwhm > 0 THEN fwhm END) AS avg_fwhm, count(*) AS n FROM {observations} WHERE hfr > 0 GROUP BY month", "avg_hfr avg_fwhm")
def _(v):
    return stats.quality_trend(v.observations)


@query("D13_object_type_stats", "WITH e AS (SELECT target_id, sum(exposure_time) AS s FROM {observations} GROUP BY target_id) SELECT coalesce(object_type, 'Unknown') AS object_type, count(*) AS n_targets, coalesce(sum(s), 0) AS total_exposure FROM {targets} LEFT JOIN e ON id = target_id GROUP BY coalesce(object_type, 'Unknown')")
def _(v):
    return stats.object_type_stats(v.targets, v.observations)


@query("D14_session_summary", """SELECT session_date, count(*) AS n_exposures, count(DISTINCT target_name) AS n_targets, sum(exposure_seconds) AS total_seconds, avg(hfr) AS avg_hfr, avg(fwhm) AS avg_fwhm, array_to_string(list_sort(list_distinct(list(target_name))), ',') AS targets,
 array_to_string(list_sort(list_distinct(list(filter_name))), ',') AS filters, array_to_string(list_sort(list_distinct(list(telescope))), ',') AS telescopes, min(timestamp) AS first_exposure, max(timestamp) AS last_exposure FROM {exposures} GROUP BY session_date""", "avg_hfr avg_fwhm")
def _(v):
    return stats.session_summary(v.exposures)


@query("D15_session_dates", "SELECT DISTINCT session_date FROM {exposures}")
def _(v):
    return v.exposures.select("session_date").distinct().orderBy(F.desc("session_date"))


@query("D16_equipment_performance", "SELECT telescope, camera, filter_name, quantile_cont(hfr, 0.5) AS median_hfr, quantile_cont(fwhm, 0.5) AS median_fwhm, min(hfr) AS best_hfr, greatest(count(hfr), count(fwhm), 1) AS frame_count, sum(exposure_seconds) AS total_seconds FROM {exposures} GROUP BY telescope, camera, filter_name", "median_hfr median_fwhm best_hfr")
def _(v):
    return stats.equipment_performance(v.exposures)


@query("D18_tracking_stats", """SELECT session_id, count(*) AS n, count(*) FILTER (status = 'TRACKING') AS n_tracking, count(*) FILTER (status = 'TRACKING') * 100.0 / count(*) AS tracking_percent, avg(ra_stdev) FILTER (status = 'TRACKING') AS avg_ra, avg(dec_stdev) FILTER (status = 'TRACKING') AS avg_dec,
 min(ra_stdev) FILTER (status = 'TRACKING') AS min_ra, max(ra_stdev) FILTER (status = 'TRACKING') AS max_ra, sqrt(avg(ra_stdev * ra_stdev) FILTER (status = 'TRACKING')) AS rms_ra, sqrt(avg(dec_stdev * dec_stdev) FILTER (status = 'TRACKING')) AS rms_dec FROM {mount_samples} GROUP BY session_id""", "tracking_percent avg_ra avg_dec min_ra max_ra rms_ra rms_dec")
def _(v):
    return stats.tracking_stats(v.mount_samples)


@query("D27_frame_metrics", "SELECT frame, count(*) AS n_stars, quantile_cont(fwhm, 0.5) AS fwhm, quantile_cont(hfr, 0.5) AS hfr, quantile_cont(eccentricity, 0.5) AS eccentricity, quantile_cont(snr, 0.5) AS snr, stddev_pop(fwhm) AS fwhm_std FROM {stars} GROUP BY frame", "fwhm hfr eccentricity snr fwhm_std")
def _(v):
    return stats.frame_metrics(v.stars)


@query("D28_trail_flag", "WITH s AS (SELECT frame, count(*) AS n, sum(cos(radians(2 * theta))) AS c, sum(sin(radians(2 * theta))) AS s FROM {stars} GROUP BY frame) SELECT frame, n, (c * c + s * s) / (n * n) AS r2, n >= 5 AND (c * c + s * s) / (n * n) > 0.5 AS trailed FROM s", "r2")
def _(v):
    return stats.trail_flag(v.stars)


@query("D39_dominant_filter", "WITH s AS (SELECT target_id, filter, CAST(sum(frame_count) AS BIGINT) AS frames FROM {observations} WHERE filter IS NOT NULL GROUP BY target_id, filter) SELECT target_id, filter, frames FROM s QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY frames DESC, filter) = 1")
def _(v):
    return stats.dominant_filter(v.observations)


@query("D45_exposure_details", "WITH p AS (SELECT target, CAST(date_obs AS DATE) AS night, filter, exposure, count(*) AS n FROM {frames} WHERE image_type = 'LIGHT' GROUP BY target, night, filter, exposure) SELECT *, sum(n * exposure) OVER (PARTITION BY target, night) AS night_seconds FROM p")
def _(v):
    return stats.exposure_details(v.frames)


_SEGMENTS = """l AS (SELECT *, lag(ra_hours) OVER w AS pr, lag(dec_degrees) OVER w AS pd FROM {mount_samples} WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, sample_id)),
 j AS (SELECT *, CASE WHEN least(abs(ra_hours - pr), 24 - abs(ra_hours - pr)) > 0.25 OR abs(dec_degrees - pd) > 2 THEN 1 ELSE 0 END AS jump FROM l),
 g AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY session_id ORDER BY timestamp, sample_id) AS BIGINT) AS segment FROM j)"""


@query("E01_segment_jumps", f"WITH {_SEGMENTS} SELECT session_id, sample_id, segment FROM g")
def _(v):
    return ordered.segment_jumps(v.mount_samples).select("session_id", "sample_id", "segment")


@query("E02_deviations", f"""WITH {_SEGMENTS}, m AS (SELECT session_id, segment, quantile_cont(ra_hours, 0.5) AS ra, quantile_cont(dec_degrees, 0.5) AS de FROM g WHERE status = 'TRACKING' GROUP BY session_id, segment)
 SELECT sample_id, g.segment, CASE WHEN status = 'TRACKING' THEN (ra_hours - ra) * 54000 * greatest(cos(radians(de)), 0.01) ELSE 0 END AS ra_off, CASE WHEN status = 'TRACKING' THEN (dec_degrees - de) * 3600 ELSE 0 END AS dec_off FROM g LEFT JOIN m ON g.session_id = m.session_id AND g.segment = m.segment""", "ra_off dec_off")
def _(v):
    return ordered.deviations(ordered.segment_jumps(v.mount_samples)).select("sample_id", "segment", "ra_off", "dec_off")


@query("E03_latest_per_axis", "SELECT session_id, axis, sample_id, ra_stdev FROM {mount_samples} QUALIFY row_number() OVER (PARTITION BY session_id, axis ORDER BY timestamp DESC, sample_id DESC) = 1")
def _(v):
    return ordered.latest_per(v.mount_samples, ["session_id", "axis"], "timestamp", "sample_id").select("session_id", "axis", "sample_id", "ra_stdev")


@query("E04_timeline", "WITH p AS (SELECT session_id, sample_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, sample_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM {mount_samples}) SELECT session_id, sample_id FROM p WHERE (r - 1) % greatest(1, n // 20) = 0")
def _(v):
    return ordered.timeline(v.mount_samples, 20).select("session_id", "sample_id")


@query("E05_nightly_series", """WITH n AS (SELECT session_date, quantile_cont(hfr, 0.5) AS median FROM {exposures} GROUP BY session_date), r AS (SELECT *, row_number() OVER (ORDER BY session_date) AS k FROM n)
 SELECT session_date, median, CASE WHEN k >= 7 THEN avg(median) OVER (ORDER BY session_date ROWS 6 PRECEDING) END AS avg_7, CASE WHEN k >= 30 THEN avg(median) OVER (ORDER BY session_date ROWS 29 PRECEDING) END AS avg_30 FROM r""", "median avg_7 avg_30")
def _(v):
    return ordered.nightly_series(v.exposures, "hfr")


@query("E06_longest_streak", "WITH d AS (SELECT DISTINCT observation_date AS d FROM {observations}), r AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS g FROM d) SELECT min(d) AS first_night, max(d) AS last_night, count(*) AS nights FROM r GROUP BY g ORDER BY nights DESC, first_night LIMIT 1")
def _(v):
    return ordered.longest_streak(v.observations)


@query("E07_year_heatmap", """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT observation_date, sum(exposure_time) / 3600 AS hours FROM {observations} GROUP BY observation_date)
 SELECT day, CAST((dayofyear(day) - 1 + isodow(DATE '1997-01-01') - 1) // 7 AS INT) AS week, CAST(isodow(day) - 1 AS INT) AS weekday, coalesce(hours, 0) AS hours FROM d LEFT JOIN h ON day = observation_date""", "hours")
def _(v):
    return ordered.year_heatmap(v.observations, 1997)


@query("E09_productive_nights", "SELECT observation_date, sum(exposure_time) AS total_exposure, count(DISTINCT target_id) AS targets FROM {observations} GROUP BY observation_date ORDER BY total_exposure DESC, observation_date LIMIT 10")
def _(v):
    nights = v.observations.groupBy("observation_date").agg(F.sum("exposure_time").alias("total_exposure"), F.countDistinct("target_id").alias("targets"))
    return nights.orderBy(F.desc("total_exposure"), "observation_date").limit(10)


@query("E10_best_sessions", "SELECT target_id, observation_date, hfr, seq, CAST(row_number() OVER (PARTITION BY target_id ORDER BY hfr, seq) AS INT) AS rank FROM {observations} WHERE hfr > 0 QUALIFY rank <= 5", "hfr")
def _(v):
    return ordered.top_per(v.observations.where("hfr > 0"), ["target_id"], ["hfr", "seq"], 5).select("target_id", "observation_date", "hfr", "seq", "rank")


@query("E11_number_frames", "SELECT path, CAST(row_number() OVER (PARTITION BY target, filter, telescope, image_type ORDER BY date_obs, path) AS INT) AS number FROM {frames}")
def _(v):
    return numbered(v.frames, ["target", "filter", "telescope", "image_type"], ["date_obs", "path"]).select("path", F.col("number").cast("int").alias("number"))


@query("E12_unique_names", "WITH p AS (SELECT path, target || '_' || filter || '_' || camera AS name FROM {frames}), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS k FROM p) SELECT path, name, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS unique_name FROM r")
def _(v):
    return ordered.unique_names(v.frames.select("path", F.concat_ws("_", "target", "filter", "camera").alias("name")), "name", "path")


@query("E13_brightest_per_cell", "WITH c AS (SELECT frame, star, CAST(least(floor(x / 750.0), 3) AS INT) AS cx, CAST(least(floor(y / 500.0), 3) AS INT) AS cy, flux FROM {stars}) SELECT frame, star, cx, cy FROM c QUALIFY row_number() OVER (PARTITION BY frame, cx, cy ORDER BY flux DESC, star) <= 1")
def _(v):
    return ordered.brightest_per_cell(v.stars, 3000.0, 2000.0, 4, 1).select("frame", "star", "cx", "cy")


@query("C01_nearest_weather", """WITH b AS (SELECT e.event_id, e.timestamp AS t, w.timestamp AS wt, w.temperature, w.humidity FROM {exposures} e ASOF LEFT JOIN (SELECT * FROM {weather} QUALIFY row_number() OVER (PARTITION BY telescope, timestamp ORDER BY weather_id DESC) = 1) w ON e.telescope = w.telescope AND e.timestamp >= w.timestamp),
 a AS (SELECT e.event_id, w.timestamp AS wt, w.temperature, w.humidity FROM {exposures} e ASOF LEFT JOIN (SELECT * FROM {weather} QUALIFY row_number() OVER (PARTITION BY telescope, timestamp ORDER BY weather_id) = 1) w ON e.telescope = w.telescope AND e.timestamp <= w.timestamp),
 g AS (SELECT b.event_id, (epoch_us(b.t) - epoch_us(b.wt)) / 1e6 AS gb, (epoch_us(a.wt) - epoch_us(b.t)) / 1e6 AS ga, b.temperature AS tb, a.temperature AS ta, b.humidity AS hb, a.humidity AS ha FROM b JOIN a ON a.event_id = b.event_id),
 n AS (SELECT event_id, CASE WHEN gb IS NULL OR ga < gb THEN ga ELSE gb END AS gap, CASE WHEN gb IS NULL OR ga < gb THEN ta ELSE tb END AS t, CASE WHEN gb IS NULL OR ga < gb THEN ha ELSE hb END AS h FROM g)
 SELECT event_id, CASE WHEN gap <= 300 THEN t END AS weather_temperature, CASE WHEN gap <= 300 THEN h END AS weather_humidity, CASE WHEN gap <= 300 THEN gap END AS gap_seconds FROM n""", "weather_temperature gap_seconds")
def _(v):
    found = joins.nearest_join(v.exposures, v.weather, "timestamp", ["telescope"], ["temperature", "humidity"], 300.0, "event_id", "weather_id")
    return found.select("event_id", "weather_temperature", "weather_humidity", "gap_seconds")


@query("C02_observations_of_targets", "SELECT name, canonical_name, object_type, observation_date, filter, exposure_time, seq FROM {targets} JOIN {observations} ON id = target_id")
def _(v):
    return v.targets.join(v.observations, F.col("id") == F.col("target_id")).select("name", "canonical_name", "object_type", "observation_date", "filter", "exposure_time", "seq")


@query("C04_tags_of_targets", "SELECT t.id, t.name, g.tag FROM {targets} t JOIN {target_tags} l ON t.id = l.target_id JOIN {tags} g ON g.tag_id = l.tag_id")
def _(v):
    return v.targets.join(v.target_tags, F.col("id") == F.col("target_id")).join(v.tags, "tag_id").select("id", "name", "tag")


_HAVERSINE = "degrees(2 * asin(least(1.0, sqrt(pow(sin(radians({b}.dec_deg - {a}.dec_deg) / 2), 2) + cos(radians({a}.dec_deg)) * cos(radians({b}.dec_deg)) * pow(sin(radians({b}.ra_deg - {a}.ra_deg) / 2), 2)))))"


@query("C12_within_radius", "WITH c AS (SELECT 180.0 AS ra_deg, 10.0 AS dec_deg) SELECT id, " + _HAVERSINE.replace("{a}", "t").replace("{b}", "c") + " AS distance FROM {targets} t, c WHERE distance <= 15", "distance")
def _(v):
    return joins.within_radius(v.targets, 180.0, 10.0, 15.0).select("id", "distance")


@query("C13_pairs_within", "SELECT a.id AS id_a, b.id AS id_b, " + _HAVERSINE.replace("{a}", "a").replace("{b}", "b") + " AS distance FROM {targets} a JOIN {targets} b ON a.id < b.id WHERE distance <= 1.5", "distance")
def _(v):
    return joins.pairs_within(v.targets, 1.5)


@query("C16_new_files", "SELECT path FROM {files} WHERE file_id NOT IN (SELECT path FROM {frames} WHERE image_type = 'LIGHT')")
def _(v):
    known = v.frames.where("image_type = 'LIGHT'").select(F.col("path").alias("file_id"))
    return v.files.join(known, "file_id", "left_anti").select("path")


@query("C17_with_equipment", "SELECT e.event_id, e.telescope, q.focal_length, q.pixel_size, q.pixel_size / q.focal_length * 206.265 AS image_scale FROM {exposures} e LEFT JOIN {equipment} q ON e.telescope = q.telescope", "image_scale")
def _(v):
    joined = v.exposures.join(v.equipment, "telescope", "left")
    return joined.select("event_id", "telescope", "focal_length", "pixel_size", (F.col("pixel_size") / F.col("focal_length") * 206.265).alias("image_scale"))


@query("G01_correlation", "SELECT telescope, count(*) AS n, corr(hfr, fwhm) AS r, regr_slope(fwhm, hfr) AS slope, regr_intercept(fwhm, hfr) AS intercept, regr_r2(fwhm, hfr) AS r2 FROM {exposures} WHERE hfr IS NOT NULL AND fwhm IS NOT NULL GROUP BY telescope HAVING count(*) >= 3", "r slope intercept r2")
def _(v):
    both = v.exposures.where("hfr is not null and fwhm is not null")
    return both.groupBy("telescope").agg(F.count("*").alias("n"), F.corr("hfr", "fwhm").alias("r"), F.regr_slope("fwhm", "hfr").alias("slope"), F.regr_intercept("fwhm", "hfr").alias("intercept"), F.regr_r2("fwhm", "hfr").alias("r2")).where("n >= 3")


@query("H02_distinct", "SELECT DISTINCT filter, telescope FROM {observations}")
def _(v):
    return v.observations.select("filter", "telescope").distinct()


@query("H03_missing_filters", "SELECT DISTINCT target_id, filter FROM {observations} WHERE telescope = 'T1' EXCEPT SELECT DISTINCT target_id, filter FROM {observations} WHERE telescope = 'T2'")
def _(v):
    at = lambda t: v.observations.where(f"telescope = '{t}'").select("target_id", "filter")
    return at("T1").subtract(at("T2"))
