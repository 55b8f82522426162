"""Registered queries over histories, reports, catalogues and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import stats
from ..operators.merge import table_rows
from ..sources import history
from ..streaming import imports
from .catalog import query
from .durable import checkpoint_folder
from .views import VIEWS


def _targets(v):
    return v.targets.select("id", "name", "canonical_name", "object_type", F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"))


@query("A23_nested_history", "SELECT t.name, count(o.seq) AS n, sum(exposure_time) AS exposure, min(observation_date) AS first_date FROM {targets} t LEFT JOIN {observations} o ON t.id = o.target_id GROUP BY t.id, t.name")
def _(v):
    nested = history.nested_history(_targets(v), v.observations)
    total = F.aggregate("observations", F.lit(0.0), lambda a, x: a + x["exposure_time"])
    return nested.select("name", F.coalesce(F.size("observations"), F.lit(0)).cast("long").alias("n"), total.alias("exposure"), F.get("observations", F.lit(0))["observation_date"].alias("first_date")).withColumn("n", F.when(F.col("exposure").isNull(), 0).otherwise(F.col("n")))


@query("A24_history_rows", "SELECT name AS target_name, canonical_name, object_type, ra_deg AS ra, dec_deg AS dec, observation_date, filter, exposure_time, frame_count, telescope, camera, hfr, fwhm FROM {observations} JOIN {targets} ON id = target_id", "ra dec hfr fwhm")
def _(v):
    return history.history_rows(_targets(v), v.observations)


@query("A25_accepted_list", "SELECT CAST(path AS STRING) AS value FROM {frames} WHERE path % 4 <> 0")
def _(v):
    return history.accepted_list(v.frames.select(F.col("path").cast("string").alias("path"), (F.col("path") % 4 == 0).alias("rejected")))


@query("A25_quality_report", "SELECT path, exposure AS score, path % 4 = 0 AS rejected FROM {frames} WHERE path % 4 <> 0")
def _(v):
    return history.quality_report(v.frames.select("path", F.col("exposure").alias("score"), (F.col("path") % 4 == 0).alias("rejected")))


@query("A28_export_filter_ids", "WITH p AS (SELECT CAST(date_obs AS DATE) AS night, filter, exposure, count(*) AS n FROM {frames} WHERE image_type = 'LIGHT' GROUP BY ALL) SELECT night AS date, CAST(CASE filter WHEN 'O' THEN 4457 WHEN 'F' THEN 4658 END AS INT) AS filter, exposure AS duration, CAST(sum(n) AS BIGINT) AS number FROM p GROUP BY ALL")
def _(v):
    ids = v.spark.createDataFrame([("O", 4457), ("F", 4658)], "filter_name string, filter_id int")
    return history.export_filter_ids(stats.exposure_details(v.frames), ids)


_PATH = "CASE o_orderkey % 7 WHEN 0 THEN '/d/M  31/LIGHT/a.fits' WHEN 1 THEN '/d/M 42/Night_2/FLAT/a.fits' WHEN 2 THEN '/d/Veil/2024-01-02/LIGHT/a.fits' WHEN 3 THEN '/Observatoire X/LIGHT/a.fits' WHEN 4 THEN '/d/Flats/LIGHT/a.fits' WHEN 5 THEN '/d/NGC 7/Nuit_1/Nuit-2/Session_3/LIGHT/a.fits' ELSE '/d/plain/a.fits' END"


@query("A04_targets_of_paths", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'M 31' WHEN 1 THEN 'M 42' END AS target FROM orders")
def _(v):
    return v.orders.selectExpr("o_orderkey", f"{_PATH} AS path").select("o_orderkey", text.target_from_path(F.col("path")).alias("target"))


@query("A17_parse_light_names", "SELECT path, CASE WHEN path % 5 > 0 THEN target END AS target, CASE WHEN path % 5 > 0 THEN exposure END AS exposure, CASE WHEN path % 5 > 0 THEN CAST(temperature AS DOUBLE) END AS temperature FROM {frames}")
def _(v):
    from ..sources.logs import parse_light_filename

    named = v.frames.select("path", F.when(F.col("path") % 5 == 0, "x.fits").otherwise(F.format_string("LIGHT_%s_2024-01-02_03-04-05_%s_1x1_%.2fs_12.5_%.1f_%s_0007.fits", "target", "filter", "exposure", "temperature", "camera")).alias("file"))
    return parse_light_filename(named, "file").select("path", "target", "exposure", "temperature")


@query("B02_parse_timestamps", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 3 THEN date_trunc('second', ts) WHEN event_id % 6 = 4 THEN date_trunc('second', ts) ELSE ts END AS timestamp FROM events WHERE day(ts) > 12 OR event_id % 6 <> 4")
def _(v):
    e = v.events.where("day(ts) > 12 or event_id % 6 <> 4")
    layouts = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]
    shown = F.lit("no time")
    for k, layout in enumerate(layouts):
        shown = F.when(F.col("event_id") % 6 == k, F.date_format("ts", layout)).otherwise(shown)
    return e.select("event_id", text.parse_timestamp(shown).cast("timestamp_ntz").alias("timestamp"))


def _streamed(v) -> tuple[str, str]:
    """The exposures of the event table through the import stream: (folder of the table, folder of the summaries)."""
    place = f"{checkpoint_folder(v.spark)}/{uuid.uuid4().hex}"
    exposures = lambda rows: rows.selectExpr(*(f"{e} AS `{c}`" for c, e in VIEWS["exposures"][1].items()))
    whole = exposures(v.events.limit(0)).withColumn(imports.BATCH, F.lit("")).schema
    then = lambda new, nights: imports.summarise(table_rows(v.spark, f"{place}/exposures", whole, nights), f"{place}/summaries")
    stream = v.spark.readStream.schema(v.events.schema).parquet(f"{v._dir}/events.parque[t]")  # a pattern, as streams take single files only by one
    imports.start_import(stream, exposures, f"{place}/exposures", f"{place}/state", "exposures", list(imports.EXPOSURE_KEY), "event_id", F.col("session_date"), then).awaitTermination()
    return f"{place}/exposures", f"{place}/summaries"


@query("J01_incremental_import", "SELECT event_id, timestamp, target_name, filter_name, file_path FROM {exposures} QUALIFY file_path IS NULL OR row_number() OVER (PARTITION BY timestamp, file_path ORDER BY event_id) = 1")
def _(v):
    folder, _ = _streamed(v)
    return table_rows(v.spark, folder, v.exposures.schema).select("event_id", "timestamp", "target_name", "filter_name", "file_path")


@query("J02_running_summary", """WITH x AS (SELECT * FROM {exposures} QUALIFY file_path IS NULL OR row_number() OVER (PARTITION BY timestamp, file_path ORDER BY event_id) = 1) SELECT session_date, count(*) AS n_exposures, count(DISTINCT target_name) AS n_targets, sum(exposure_seconds) AS total_seconds, avg(hfr) AS avg_hfr, avg(fwhm) AS avg_fwhm,
 array_to_string(list_sort(list(DISTINCT target_name)), ',') AS targets, array_to_string(list_sort(list(DISTINCT filter_name)), ',') AS filters, array_to_string(list_sort(list(DISTINCT telescope)), ',') AS telescopes, min(timestamp) AS first_exposure, max(timestamp) AS last_exposure FROM x GROUP BY session_date""", "avg_hfr avg_fwhm")
def _(v):
    _, summaries = _streamed(v)
    return imports.running_summary(v.spark, summaries, stats.session_summary(v.exposures).schema)
