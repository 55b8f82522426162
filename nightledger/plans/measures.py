"""Registered queries over statistics, images, warnings, plans and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming, sky
from ..operators import calibration, images, listings, ordered, signals, stats, upserts
from .catalog import query

_OBS = "o AS (SELECT coalesce(nullif(telescope, ''), 'Unknown') AS telescope, coalesce(nullif(camera, ''), 'Unknown') AS camera, coalesce(nullif(filter, ''), 'Unknown') AS filter, hfr, fwhm FROM {observations} WHERE telescope IS NOT NULL AND camera IS NOT NULL)"


@query("D17_equipment_performance_obs", f"WITH {_OBS} SELECT telescope, camera, filter, count(*) AS frame_count, min(hfr) AS best_hfr, list_extract(list_sort(list(hfr)), CAST(count(hfr) // 2 + 1 AS INT)) AS median_hfr, list_extract(list_sort(list(fwhm)), CAST(count(fwhm) // 2 + 1 AS INT)) AS median_fwhm FROM o GROUP BY telescope, camera, filter", "best_hfr median_hfr median_fwhm")
def _(v):
    return stats.equipment_performance_obs(v.observations)


@query("D29_batch_summary", """WITH m AS (SELECT frame, quantile_cont(fwhm, 0.5) AS fwhm, quantile_cont(eccentricity, 0.5) AS e, quantile_cont(snr, 0.5) AS s, count(*) AS n FROM {stars} GROUP BY frame), q AS (SELECT *, 0.35 * greatest(0, least(100, (fwhm - 8) / -6 * 100)) + 0.2 * greatest(0, least(100, (e - 0.8) / -0.5 * 100)) + 0.2 * greatest(0, least(100, (s - 5) / 45 * 100)) + 0.15 * greatest(0, least(100, (n - 5) / 95.0 * 100)) + 0.1 * greatest(0, least(100, (1 - e - 0.3) / 0.5 * 100)) AS score FROM m)
 SELECT frame % 20 AS batch, count(*) AS frames, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score, stddev_pop(score) AS std_score, quantile_cont(fwhm, 0.5) AS median_fwhm, arg_min(frame, (-round(score, 9), frame)) AS best_frame, arg_min(frame, (round(score, 9), frame)) AS worst_frame FROM q GROUP BY batch""", "mean_score median_score std_score median_fwhm")
def _(v):
    m = stats.frame_metrics(v.stars)
    score = sky.quality_score({"fwhm": F.col("fwhm"), "eccentricity": F.col("eccentricity"), "snr": F.col("snr"), "stars": F.col("n_stars"), "roundness": 1 - F.col("eccentricity")})
    return stats.batch_summary(m.withColumn("score", score).withColumn("batch", F.col("frame") % 20), "batch")


@query("E14_flag_rejections", """WITH m AS (SELECT frame, count(*) AS n, quantile_cont(fwhm, 0.5) AS fwhm, quantile_cont(eccentricity, 0.5) AS e, pow(sum(cos(radians(2 * theta))), 2) + pow(sum(sin(radians(2 * theta))), 2) AS r FROM {stars} GROUP BY frame), b AS (SELECT frame % 50 AS batch, quantile_cont(fwhm, 0.5) AS middle FROM m WHERE fwhm > 0 GROUP BY batch)
 SELECT frame, array_to_string(list_filter([CASE WHEN fwhm > 3.5 THEN 'score' END, CASE WHEN e > 0.4 THEN 'eccentricity' END, CASE WHEN n < 3 THEN 'stars' END, CASE WHEN n >= 5 AND r / (n * n) > 0.5 THEN 'trail' END, CASE WHEN fwhm > 1.2 * middle THEN 'fwhm' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m JOIN b ON frame % 50 = batch""")
def _(v):
    trails = stats.trail_flag(v.stars).select("frame", "trailed")
    frames = stats.frame_metrics(v.stars).join(trails, "frame").withColumn("batch", F.col("frame") % 50).withColumn("score", F.when(F.col("fwhm") > 3.5, 0.0).otherwise(100.0))
    return ordered.flag_rejections(frames, ["batch"], 30.0, 0.4, 3, 1.2).select("frame", "reasons")


@query("E08_best_and_worst", " UNION ALL ".join(f"SELECT * FROM (SELECT file, '{c}' AS measure, '{k}' AS kind FROM {{subframes}} WHERE {c} IS NOT NULL ORDER BY {c} {d}, file LIMIT 10)" for c in ("fwhm", "snr") for k, d in (("low", ""), ("high", "DESC"))))
def _(v):
    return ordered.best_and_worst(v.subframes, "fwhm", ["file"], 10).unionByName(ordered.best_and_worst(v.subframes, "snr", ["file"], 10))


_GROUPED = """g AS (SELECT target, filter, count(*) AS n, avg(temperature) AS mean, arg_min(struct_pack(exposure := exposure, camera := camera), (date_obs, path)) AS one FROM {frames} WHERE image_type = 'LIGHT' GROUP BY target, filter),
 x AS (SELECT target, filter, n, (SELECT count(*) FROM {frames} f WHERE f.image_type = 'DARK' AND f.gain = 100 AND f.camera = g.one.camera AND abs(f.exposure - g.one.exposure) < 0.01) AS nd, (SELECT min(abs(f.temperature - mean)) FROM {frames} f WHERE f.image_type = 'DARK' AND f.gain = 100 AND f.camera = g.one.camera AND abs(f.exposure - g.one.exposure) < 0.01) AS gap,
 (SELECT count(*) FROM {frames} f WHERE f.image_type = 'FLAT' AND f.filter = g.filter AND f.camera = g.one.camera AND f.gain = 0) AS nf, (SELECT count(*) FROM {frames} f WHERE f.image_type = 'BIAS' AND f.camera = g.one.camera) AS nb FROM g)"""


@query("D34_validation_warnings", f"""WITH {_GROUPED} SELECT target, filter, 'few frames' AS rule, CAST(n AS DOUBLE) AS detail FROM x WHERE n < 30 UNION ALL SELECT target, filter, 'no darks', 0 FROM x WHERE nd = 0 UNION ALL SELECT target, filter, 'dark temperature', gap FROM x WHERE gap > 0.1 UNION ALL SELECT target, filter, 'no flats', 0 FROM x WHERE nf = 0 UNION ALL SELECT target, filter, 'no biases', 0 FROM x WHERE nb = 0
 UNION ALL SELECT target, NULL, 'mixed cameras', CAST(count(DISTINCT camera) AS DOUBLE) FROM {{frames}} WHERE image_type = 'LIGHT' GROUP BY target HAVING count(DISTINCT camera) > 1 UNION ALL SELECT target, NULL, 'mixed telescopes', CAST(count(DISTINCT telescope) AS DOUBLE) FROM {{frames}} WHERE image_type = 'LIGHT' GROUP BY target HAVING count(DISTINCT telescope) > 1""", "detail")
def _(v):
    pools = v.frames.where("image_type not in ('DARK', 'FLAT') or (image_type = 'DARK' and gain = 100) or (image_type = 'FLAT' and gain = 0)")
    return stats.validation_warnings(v.frames, calibration.candidates(pools), 30, 0.1)


@query("D36_storage_breakdown", r"""WITH f AS (SELECT regexp_extract(path, '(\.fits\.fz|\.[a-z]+)$', 1) AS format, length, file_id % 5 = 0 AS shelf, file_id % 3 = 0 AS processed FROM {files}) SELECT format, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (shelf) AS calibration_files, CAST(coalesce(sum(length) FILTER (shelf), 0) AS BIGINT) AS calibration_bytes, CAST(coalesce(sum(length) FILTER (format = '.xisf' AND NOT processed), 0) AS BIGINT) AS recompressible FROM f GROUP BY format""")
def _(v):
    files = v.files.select(F.concat(F.when(F.col("file_id") % 5 == 0, "/Darks/").otherwise("/x/"), F.when(F.col("file_id") % 3 == 0, "Master").otherwise(""), F.element_at(F.split("path", "/"), -1)).alias("path"), "length")
    return stats.storage_breakdown(files, naming.is_processed_path(F.col("path")))


@query("D38_region_stats", """WITH s AS (SELECT CAST(least(floor(y / (2000.0 / 3)), 2) AS INT) AS r, CAST(least(floor(x / (3000.0 / 3)), 2) AS INT) AS c, fwhm FROM {stars}), g AS (SELECT CAST(i // 3 AS INT) AS "row", CAST(i % 3 AS INT) AS col FROM range(9) t(i))
 SELECT "row", col, count(fwhm) AS n, quantile_cont(fwhm, 0.5) AS median_fwhm, min(fwhm) AS min_fwhm, max(fwhm) AS max_fwhm, avg(fwhm) AS mean_fwhm, stddev_pop(fwhm) AS std_fwhm FROM g LEFT JOIN s ON r = "row" AND c = col GROUP BY "row", col""", "median_fwhm min_fwhm max_fwhm mean_fwhm std_fwhm")
def _(v):
    return stats.region_stats(v.stars, 3000.0, 2000.0)


@query("G02_spearman", """WITH r AS (SELECT telescope, rank() OVER (PARTITION BY telescope ORDER BY hfr) + (count(*) OVER (PARTITION BY telescope, hfr) - 1) / 2 AS x, rank() OVER (PARTITION BY telescope ORDER BY fwhm) + (count(*) OVER (PARTITION BY telescope, fwhm) - 1) / 2 AS y FROM {exposures} WHERE fwhm IS NOT NULL)
 SELECT telescope, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY telescope""", "rho")
def _(v):
    return signals.spearman(v.exposures, ["telescope"], "hfr", "fwhm")


@query("G03_regression_band", """WITH p AS (SELECT hfr AS x, fwhm AS y FROM {exposures} WHERE hfr IS NOT NULL AND fwhm IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS mx, min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), q AS (SELECT sqrt(sum(pow(y - (s * x + i), 2)) / (any_value(n) - 2)) AS se, sum(pow(x - mx, 2)) AS sxx FROM p, m), g AS (SELECT CAST(unnest(range(0, 100)) AS INT) AS place),
 t AS (SELECT 1.959963984540054 AS z, n - 2.0 AS v FROM m), k AS (SELECT z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) AS tq FROM t) SELECT place, lo + (hi - lo) * place / 99 AS x, s * (lo + (hi - lo) * place / 99) + i AS fitted, tq * se * sqrt(1.0 / n + pow(lo + (hi - lo) * place / 99 - mx, 2) / sxx) AS half_width FROM g, m, q, k""", "x fitted half_width")
def _(v):
    return signals.regression_band(v.exposures, "hfr", "fwhm")


@query("G04_correlation_p", """WITH r AS (SELECT target_name, count(*) AS n, corr(hfr, fwhm) AS r FROM {exposures} WHERE hfr IS NOT NULL AND fwhm IS NOT NULL GROUP BY target_name HAVING count(*) >= 3), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0 AS v FROM r), e AS (SELECT *, least(pi() / 2, 14 / sqrt(v)) AS edge FROM t), a AS (SELECT *, least(atan(abs(t) / sqrt(v)), edge) AS ang FROM e),
 i AS (SELECT target_name, sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(k * ang / 4000), v - 1)) * ang AS x, sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(k * edge / 4000), v - 1)) * edge AS y FROM a, range(0, 4001) g(k) GROUP BY target_name, ang, edge) SELECT r.target_name, n, r, greatest(0, 1 - x / y) AS p FROM r JOIN i USING (target_name)""", "r p")
def _(v):
    both = v.exposures.where("hfr is not null and fwhm is not null").groupBy("target_name").agg(F.count("*").alias("n"), F.corr("hfr", "fwhm").alias("r")).where("n >= 3")
    return both.withColumn("p", signals.correlation_p(F.col("r"), F.col("n")))


_SIGNAL, _SKY = "x between 2 and 5 and y between 2 and 5", "x < 2 or x > 5"
_REGION = f"""b AS (SELECT image_id, quantile_cont(value, 0.5) AS bg, avg(value) AS bm, stddev_samp(value) AS bs FROM {{pixels}} WHERE {_SKY} GROUP BY image_id), m AS (SELECT p.image_id, avg(value - bg) AS mean, quantile_cont(value - bg, 0.5) AS med, var_samp(value - bg) AS var, count(*) AS n, avg(value) AS raw, any_value(bm) AS bm, any_value(bs) AS bs FROM {{pixels}} p JOIN b ON b.image_id = p.image_id WHERE {_SIGNAL} GROUP BY p.image_id),
 s AS (SELECT *, CASE WHEN greatest(mean, 0) + greatest(bm, 0) > 0 THEN mean / sqrt(greatest(mean, 0) + greatest(bm, 0)) ELSE 0 END AS sp, CASE WHEN bs > 0 THEN (raw - bm) / bs ELSE 0 END AS sf FROM m)"""


@query("G09_snr_models", f"WITH {_REGION} SELECT image_id, mean, med AS median, sp AS snr_photon, sf AS snr_flux FROM s", "mean median snr_photon snr_flux")
def _(v):
    return signals.region_measures(v.pixels, _SIGNAL, _SKY).select("image_id", "mean", "median", "snr_photon", "snr_flux")


_PAIRED = f"{_REGION}, p AS (SELECT a.image_id AS a, b.image_id AS b, a.mean AS ma, b.mean AS mb, a.med AS da, b.med AS db, a.var / a.n AS ea, b.var / b.n AS eb, a.var AS va, b.var AS vb, a.n AS na, b.n AS nb, a.sp AS pa, b.sp AS pb, a.sf AS fa, b.sf AS fb FROM s a JOIN s b ON b.image_id = a.image_id + 1)"


def _compared(v):
    measures = signals.region_measures(v.pixels, _SIGNAL, _SKY)
    pairs = measures.select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b"))
    return signals.compare_images(measures, pairs)


@query("G08_attenuation", f"WITH {_PAIRED} SELECT a, b, CASE WHEN da > 0 AND db > 0 THEN (1 - db / da) * 100 ELSE 0 END AS attenuation_pct, CASE WHEN da > 0 AND db > 0 THEN -2.5 * log10(CASE WHEN da > 0 AND db > 0 THEN db / da END) ELSE 0 END AS attenuation_mag FROM p", "attenuation_pct attenuation_mag")
def _(v):
    return _compared(v).select("a", "b", "attenuation_pct", "attenuation_mag")


@query("G10_compare_images", f"WITH {_PAIRED} SELECT a, b, (ma - mb) / sqrt(ea + eb) AS t, pow(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS df, (ma - mb) / sqrt((va + vb) / 2) AS cohen_d, CASE WHEN pa > 0 AND pb > 0 THEN pow(pa / pb, 2) ELSE 0 END AS exposure_factor_photon, CASE WHEN fa > 0 AND fb > 0 THEN pow(fa / fb, 2) ELSE 0 END AS exposure_factor_flux FROM p", "t df cohen_d exposure_factor_photon exposure_factor_flux")
def _(v):
    return _compared(v).select("a", "b", "t", "df", "cohen_d", "exposure_factor_photon", "exposure_factor_flux")


@query("G11_percentiles", "SELECT image_id, s AS share, quantile_cont(value, 0.01) AS value FROM {pixels}, (SELECT 0.01 AS s) GROUP BY image_id, s UNION ALL SELECT image_id, 0.5, quantile_cont(value, 0.5) FROM {pixels} GROUP BY image_id UNION ALL SELECT image_id, 0.99, quantile_cont(value, 0.99) FROM {pixels} GROUP BY image_id", "value share")
def _(v):
    return signals.image_percentiles(v.pixels, (0.01, 0.5, 0.99))


@query("G11_log_histogram", "WITH e AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM {pixels} GROUP BY image_id) SELECT p.image_id, CAST(least(floor((value - lo) / (hi - lo) * 256), 255) AS INT) AS bin, ln(1 + count(*)) AS log_n FROM {pixels} p JOIN e ON e.image_id = p.image_id GROUP BY p.image_id, bin", "log_n")
def _(v):
    return images.histogram(v.pixels, 256).select("image_id", "bin", F.log1p("n").alias("log_n"))


@query("G12_compare_series", """WITH a AS (SELECT x, y, value FROM {pixels} WHERE image_id = 1), b AS (SELECT x, y, value FROM {pixels} WHERE image_id = 2), p AS (SELECT (a.value - (SELECT min(value) FROM a)) / ((SELECT max(value) - min(value) FROM a)) AS u, (b.value - (SELECT min(value) FROM b)) / ((SELECT max(value) - min(value) FROM b)) AS v FROM a JOIN b ON a.x = b.x AND a.y = b.y) SELECT count(*) AS n, sqrt(avg(pow(u - v, 2))) AS rmse, avg(abs(u - v)) AS mae, corr(u, v) AS r FROM p""", "rmse mae r")
def _(v):
    series = lambda k: v.pixels.where(f"image_id = {k}").select((F.col("x") + 8 * F.col("y")).alias("at"), "value")
    return images.compare_series(series(1), series(2), "at", "value")


@query("G13_stretch", """WITH e AS (SELECT image_id, quantile_cont(value, 0.0005) AS lo, quantile_cont(value, 0.9995) AS hi FROM {pixels} GROUP BY image_id), n AS (SELECT p.image_id, lo, hi, (greatest(lo, least(hi, value)) - lo) / (hi - lo) AS v FROM {pixels} p JOIN e ON e.image_id = p.image_id), m AS (SELECT image_id, quantile_cont(v, 0.5) AS median FROM n GROUP BY image_id),
 d AS (SELECT n.image_id, lo, hi, median, quantile_cont(abs(v - median), 0.5) AS mad FROM n JOIN m ON m.image_id = n.image_id GROUP BY n.image_id, lo, hi, median), s AS (SELECT *, greatest(0, median - 2.8 * mad) AS shadow FROM d), x AS (SELECT *, (median - shadow) / (1 - shadow) AS x FROM s)
 SELECT image_id, lo, hi, median, mad, shadow, CASE WHEN x <= 0 OR x >= 1 THEN 0.5 ELSE greatest(0.001, least(0.999, (0.25 * x - x) / (0.5 * x - 0.25 - x))) END AS midtone FROM x""", "lo hi median mad shadow midtone")
def _(v):
    return signals.stretch(v.pixels)


@query("G13_midtones", "SELECT image_id, x, y, CASE WHEN value <= 0 THEN 0 WHEN value >= 1 THEN 1 ELSE (0.25 - 1) * value / ((0.5 - 1) * value - 0.25) END AS value FROM {pixels}", "value")
def _(v):
    return v.pixels.select("image_id", "x", "y", images.mtf(F.col("value"), F.lit(0.25)).alias("value"))


@query("G14_metric_histogram", "WITH m AS (SELECT min(hfr) AS lo, max(hfr) AS hi, CAST(least(30, greatest(5, count(*) // 3)) AS INT) AS bins FROM {exposures}), b AS (SELECT CAST(least(floor((hfr - lo) / (hi - lo) * bins), bins - 1) AS INT) AS bin, lo, hi, bins FROM {exposures}, m) SELECT bin, lo + (hi - lo) * bin / bins AS low, count(*) AS n FROM b GROUP BY bin, lo, hi, bins", "low")
def _(v):
    return signals.metric_histogram(v.exposures, "hfr")


@query("G14_metric_points", "SELECT frame AS path, x, y FROM (SELECT frame, quantile_cont(fwhm, 0.5) AS x, quantile_cont(eccentricity, 0.5) AS y FROM {stars} GROUP BY frame) WHERE x IS NOT NULL AND y IS NOT NULL", "x y")
def _(v):
    return signals.metric_points(stats.frame_metrics(v.stars), "frame", "fwhm", "eccentricity", "n_stars").withColumnRenamed("frame", "path")


@query("H01_union_all", "SELECT 'exposure' AS kind, event_id AS id, timestamp, hfr, NULL AS cloud_cover FROM {exposures} UNION ALL SELECT 'weather', weather_id, timestamp, NULL, cloud_cover FROM {weather}", "hfr")
def _(v):
    return listings.union_all(v.exposures.select(F.lit("exposure").alias("kind"), F.col("event_id").alias("id"), "timestamp", "hfr"), v.weather.select(F.lit("weather").alias("kind"), F.col("weather_id").alias("id"), "timestamp", "cloud_cover"))


@query("H04_order_by", "SELECT CAST(row_number() OVER (ORDER BY target, date_obs DESC, path) AS BIGINT) AS place, path FROM (SELECT * FROM {frames} ORDER BY target, date_obs DESC, path LIMIT 200)")
def _(v):
    top = listings.listing(v.frames, {}, ["target", F.desc("date_obs"), "path"]).limit(200)
    return ordered.top_per(top.withColumn("one", F.lit(1)), ["one"], ["target", F.desc("date_obs"), "path"], 200).select(F.col("rank").cast("long").alias("place"), "path")


@query("I03_upsert_canonical", """WITH b AS (SELECT id, name, canonical_name, object_type FROM {targets} QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY id) = 1), n AS (SELECT id + 100000 AS id, 'new ' || name AS name, CASE WHEN id % 3 = 0 THEN 'only ' || id ELSE canonical_name END AS canonical_name, 'T' || id AS object_type FROM {targets}), i AS (SELECT canonical_name, arg_max(object_type, id) AS t FROM n GROUP BY canonical_name)
 SELECT b.id, b.name, b.canonical_name, coalesce(i.t, b.object_type) AS object_type FROM b LEFT JOIN i ON i.canonical_name = b.canonical_name UNION ALL SELECT id, name, canonical_name, object_type FROM n WHERE canonical_name NOT IN (SELECT canonical_name FROM b)""")
def _(v):
    first = v.targets.groupBy("canonical_name").agg(F.min_by(F.struct("id", "name", "object_type"), "id").alias("r"))
    base = first.select("r.id", "r.name", "canonical_name", "r.object_type")
    new = v.targets.select((F.col("id") + 100000).alias("id"), F.concat(F.lit("new "), "name").alias("name"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("NAME only "), F.col("id"))).otherwise(F.concat(F.lit("NAME "), "canonical_name")).alias("canonical_name"), F.concat(F.lit("T"), F.col("id")).alias("object_type"))
    return upserts.upsert_canonical(base, new)


@query("I04_store_analysis", """WITH n AS (SELECT target, CAST(date_obs AS DATE) AS night, filter, sum(exposure) AS exposure_time, count(*) AS frame_count FROM {frames} WHERE image_type = 'LIGHT' GROUP BY target, night, filter), o AS (SELECT 'M ' || (target_id % 40) AS target, observation_date AS night, CASE WHEN seq % 3 = 0 THEN NULL ELSE 'O' END AS filter, exposure_time, CAST(frame_count AS BIGINT) AS frame_count, seq FROM {observations})
 SELECT target, night, filter, exposure_time, frame_count FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.target = o.target AND n.night = o.night AND coalesce(n.filter, '') = coalesce(o.filter, '')) UNION ALL SELECT * FROM n""")
def _(v):
    have = v.observations.select(F.concat(F.lit("M "), F.col("target_id") % 40).alias("target"), F.col("observation_date").alias("night"), F.when(F.col("seq") % 3 != 0, "O").alias("filter"), "exposure_time", F.col("frame_count").cast("long").alias("frame_count"), "seq")
    return upserts.store_analysis(have, stats.exposure_details(v.frames), ["target", "night", "filter"]).drop("seq")


@query("I05_delete_older", "SELECT seq FROM {observations} WHERE observation_date >= DATE '1998-01-01' - 700")
def _(v):
    return upserts.delete_older(v.observations, "observation_date", "1998-01-01", 700).select("seq")


@query("I06_assign_and_stage", "WITH l AS (SELECT target_id, tag_id FROM {target_tags} UNION SELECT id, 3 FROM {targets} WHERE priority > 40), c AS (SELECT target_id, count(*) AS n_tags FROM l GROUP BY target_id) SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE 'planned' END AS stage, n_tags FROM {targets} JOIN c ON target_id = id")
def _(v):
    links = upserts.assign_tags(v.target_tags, v.targets.where("priority > 40"), 3)
    changes = v.targets.select("id", F.when(F.col("id") % 4 == 0, "done").otherwise("unknown stage").alias("stage"))
    staged = upserts.set_stage(v.targets.select("id", F.lit("planned").alias("stage")), changes)
    return staged.join(links.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_tags")), "id")


@query("I07_upsert_notes", """WITH n AS (SELECT CAST(ts AS DATE) AS session_date, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'NGC ' || user_id END AS target_name, event_type || event_id AS note, event_id AS row FROM events), a AS (SELECT * FROM n WHERE row % 2 = 0), b AS (SELECT * FROM n WHERE row % 2 = 1 QUALIFY row_number() OVER (PARTITION BY session_date, target_name ORDER BY row DESC) = 1)
 SELECT session_date, target_name, note FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.session_date = a.session_date AND b.target_name = a.target_name) UNION ALL SELECT session_date, target_name, note FROM b""")
def _(v):
    n = v.events.select(F.to_date("ts").alias("session_date"), F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("NGC "), F.col("user_id"))).alias("target_name"), F.concat("event_type", F.col("event_id")).alias("note"), F.col("event_id").alias("row"))
    return upserts.upsert_notes(n.where("row % 2 = 0"), n.where("row % 2 = 1")).drop("row")


@query("I08_fill_object_types", "WITH d AS (SELECT canonical_name, min(object_type) AS t FROM {targets} GROUP BY canonical_name) SELECT id, coalesce(object_type, t) AS object_type FROM {targets} LEFT JOIN d USING (canonical_name)")
def _(v):
    types = v.targets.select(F.col("canonical_name").alias("name"), "object_type")
    return upserts.fill_object_types(v.targets, types).select("id", "object_type")


_TO = "'/out/' || CASE WHEN image_type IN ('DARK', 'BIAS') THEN camera || '/' || image_type || '/' || CAST(CAST(exposure AS INT) AS STRING) || '_' || CAST(CAST(temperature AS INT) AS STRING) ELSE target || '/' || image_type || '/' || filter END"
_PLAN = f"p AS (SELECT path, image_type, {_TO} AS folder, {_TO} || '/f' || (path % 7) || '.fits' AS d FROM {{frames}}), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY path) AS k FROM p)"


def _plan(v):
    return listings.build_plan(v.frames.withColumn("file", F.concat(F.lit("f"), F.col("path") % 7, F.lit(".fits"))), "/out", "file")


@query("I09_build_plan", f"WITH {_PLAN} SELECT path, image_type, CASE WHEN k = 1 THEN d ELSE replace(d, '.fits', '_' || k || '.fits') END AS destination, 'ok' AS status FROM k")
def _(v):
    return _plan(v)


@query("I10_rename_plan", "SELECT path, image_type || '_' || target || '_' || strftime(CAST(date_obs AS TIMESTAMP), '%Y-%m-%d') || '_' || printf('%04d', CAST(row_number() OVER (PARTITION BY target, filter, telescope, image_type ORDER BY date_obs, path) AS INT)) AS base FROM {frames}")
def _(v):
    plan = listings.rename_plan(v.frames, "", "$$IMAGETYPE$$_$$TARGETNAME$$_$$DATE$$_$$FRAMENR$$")
    return plan.select("path", F.regexp_extract("name", r"^(.*_\d{4,})(_\d+)?$", 1).alias("base")).withColumn("base", F.regexp_replace("base", r"(_\d{4,})_\d+$", "$1"))


@query("D35_plan_statistics", f"WITH {_PLAN} SELECT image_type, 'ok' AS status, count(*) AS n_files, count(DISTINCT folder) AS n_folders FROM k GROUP BY image_type")
def _(v):
    return listings.plan_statistics(_plan(v))


@query("D35_folder_tree", f"WITH {_PLAN}, s AS (SELECT string_split(folder, '/') AS s FROM k), u AS (SELECT unnest(range(1, len(s) + 1)) AS depth, s FROM s) SELECT array_to_string(s[1:depth], '/') AS folder, CAST(depth AS INT) AS depth, count(*) AS n_files FROM u GROUP BY 1, 2")
def _(v):
    return listings.folder_tree(_plan(v))


@query("A20_select_image_files", "SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1)")
def _(v):
    files = v.documents.selectExpr("doc_id", "CASE doc_id % 5 WHEN 0 THEN '/a/light.FITS' WHEN 1 THEN '/a/b/x.fits.fz' WHEN 2 THEN '/a/Masters/x.xisf' WHEN 3 THEN '/Darks/x.fits' ELSE '/a/x.txt' END AS path")
    return listings.select_image_files(files, skip_calibration=True).select("doc_id")
