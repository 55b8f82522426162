"""Statistics of processing logs, mounts and nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The hours that are tried, in this order, where the wanted one is missing.
HOURS_INSTEAD = (22, 23, 0, 1, 2, 21, 20)


def none_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def subframe_quality(subframes: DataFrame, keys: list[str]) -> DataFrame:
    """Averages and ranges by ``keys``; a null key is 'Unknown', an average of zero is null."""
    named = subframes.withColumns({k: F.coalesce(F.col(k), F.lit("Unknown")) for k in keys})
    mean = lambda c: none_if_zero(F.avg(c)).alias(f"avg_{c}")
    ends = [f(c).alias(f"{n}_{c}") for c in ("fwhm", "snr") for n, f in (("min", F.min), ("max", F.max))]
    return named.groupBy(*keys).agg(F.count("*").alias("n"), *map(mean, ("fwhm", "eccentricity", "snr", "num_stars", "median_adu")), *ends)


def quality_trends(subframes: DataFrame, sessions: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` sessions by time with their averages. Both sides are one row a session before they are joined, so no log row multiplies frames."""
    per = subframes.groupBy("session_id").agg(none_if_zero(F.avg("fwhm")).alias("avg_fwhm"), none_if_zero(F.avg("eccentricity")).alias("avg_eccentricity"), none_if_zero(F.avg("snr")).alias("avg_snr"), F.count("*").alias("frame_count"))
    latest = sessions.groupBy("session_id").agg(F.max("log_date").alias("log_date"))
    return per.join(latest, "session_id", "left").orderBy(F.asc_nulls_first("log_date"), "session_id").limit(most)


def integration_with_weights(integrations: DataFrame, weights: DataFrame) -> DataFrame:
    """Each integration with its frames' (weight, file), heaviest first. A frame list is as long as one integration."""
    nested = weights.groupBy("integration_id").agg(F.sort_array(F.collect_list(F.struct("normalized_weight", "filename")), asc=False).alias("frames"))
    return integrations.join(nested, "integration_id", "left")


def attach_by_basename(weights: DataFrame, rejections: DataFrame, columns: list[str]) -> DataFrame:
    """``weights`` with ``columns`` of the rejection row of the same integration and file name, whatever the folder."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    other = rejections.groupBy("integration_id", base(F.col("filename")).alias("_base")).agg(*(F.min(c).alias(c) for c in columns))
    return weights.withColumn("_base", base(F.col("filename"))).join(other, ["integration_id", "_base"], "left").drop("_base")


def rejection_stats(weights: DataFrame) -> DataFrame:
    """By session: frames, accepted, rejected, acceptance rate in per cent, mean weights of both."""
    of = lambda test, c: F.avg(F.when(test, F.col(c)))
    ok = F.col("accepted")
    return weights.groupBy("session_id").agg(F.count("*").alias("total_frames"), F.count(F.when(ok, 1)).alias("accepted_count"), F.count(F.when(~ok, 1)).alias("rejected_count"), (F.count(F.when(ok, 1)) * 100.0 / F.count("*")).alias("acceptance_rate"), none_if_zero(of(ok, "normalized_weight")).alias("avg_weight_accepted"), none_if_zero(of(~ok, "normalized_weight")).alias("avg_weight_rejected"))


def rejected_frames(weights: DataFrame) -> DataFrame:
    return weights.where("not accepted").select("session_id", "filename", "normalized_weight").orderBy(F.asc_nulls_first("normalized_weight"), "filename")


def filter_efficiency(integrations: DataFrame) -> DataFrame:
    sums = integrations.where("filter_name is not null").groupBy("filter_name").agg(F.sum("frames_total").alias("total_frames"), F.sum("frames_integrated").alias("total_integrated"), F.sum(F.col("frames_total") - F.col("frames_integrated")).alias("total_rejected"), none_if_zero(F.avg("total_rejection_pct")).alias("avg_pixel_rejection_pct"))
    return sums.withColumn("rejection_rate", F.when(F.col("total_frames") > 0, F.col("total_rejected") * 100.0 / F.col("total_frames")).otherwise(0.0))


def processing_summary(sessions: DataFrame, integrations: DataFrame, calibrations: DataFrame) -> DataFrame:
    """The latest log of each session with its numbers of integrations and of calibration groups."""
    latest = sessions.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("row_id")))).where("_r = 1").drop("_r")
    count = lambda t, name: t.groupBy("session_id").agg(F.count("*").alias(name))
    joined = latest.join(count(integrations, "integration_count"), "session_id", "left").join(count(calibrations, "calibration_count"), "session_id", "left")
    return joined.fillna(0, ["integration_count", "calibration_count"])


def seeing_estimate(subframes: DataFrame, scale: float | None) -> DataFrame:
    """By session: FWHM in pixels and, with a scale, in arc seconds."""
    per = subframes.where("fwhm is not null").groupBy("session_id").agg(F.avg("fwhm").alias("avg_fwhm_px"), F.min("fwhm").alias("min_fwhm_px"), F.max("fwhm").alias("max_fwhm_px"))
    return per.withColumns({f"{k}_seeing_arcsec": F.col(f"{k}_fwhm_px") * scale if scale else F.lit(None).cast("double") for k in ("avg", "min", "max")})


def calibration_summary(groups: DataFrame, session: int | None = None) -> DataFrame:
    rows = groups if session is None else groups.where(F.col("session_id") == session)
    return rows.orderBy("session_id", "frame_type", F.asc_nulls_first("filter_name"))


def segment_stats(samples: DataFrame) -> DataFrame:
    """By session and segment: counts, and of the tracking samples means, RMS and range of the deviations (ra_off, dec_off)."""
    on = F.col("status") == "TRACKING"
    of = lambda c: F.when(on, F.col(c))
    span = lambda c: (F.coalesce(F.max(of(c)), F.lit(0.0)) - F.coalesce(F.min(of(c)), F.lit(0.0)))
    rms = lambda c: F.sqrt(none_if_zero(F.avg(of(c) * F.col(c))))
    return samples.groupBy("session_id", "segment").agg(
        F.count("*").alias("total_samples"), F.count(F.when(on, 1)).alias("tracking_samples"), F.avg(of("ra_hours")).alias("avg_ra_hours"), F.avg(of("dec_degrees")).alias("avg_dec_degrees"), F.avg(of("ra_stdev")).alias("ra_stdev_mean"), F.avg(of("dec_stdev")).alias("dec_stdev_mean"),
        rms("ra_off").alias("ra_rms"), rms("dec_off").alias("dec_rms"), span("ra_off").alias("ra_range"), span("dec_off").alias("dec_range"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
    )


def time_stability(times: DataFrame) -> DataFrame:
    """By session: samples, mean and spread of the clock difference, mean and maximum of both loops, in milliseconds."""
    return times.groupBy("session_id").agg(
        F.count("*").alias("samples"), F.avg("pc_mount_diff_ms").alias("pc_mount_diff_mean"), F.stddev_samp("pc_mount_diff_ms").alias("pc_mount_diff_stdev"), F.avg("pc_loop_ms").alias("pc_loop_mean"), F.max("pc_loop_ms").alias("pc_loop_max"), F.avg("mount_loop_ms").alias("mount_loop_mean"), F.max("mount_loop_ms").alias("mount_loop_max")
    )


def imaging_efficiency(dark: DataFrame, exposures: DataFrame, observations: DataFrame) -> DataFrame:
    """session_date, dark_hours, integration_hours and efficiency_pct (100 at most) of nights with dark hours; integration is that of exposures, of observations where they give none."""
    own = exposures.groupBy("session_date").agg(F.sum("exposure_seconds").alias("a"))
    other = observations.groupBy(F.col("observation_date").alias("session_date")).agg(F.sum("exposure_time").alias("b"))
    joined = dark.where("dark_hours > 0").join(own, "session_date", "left").join(other, "session_date", "left")
    seconds = F.greatest(F.coalesce(none_if_zero(F.col("a")), F.col("b"), F.lit(0.0)), F.lit(0.0))
    return joined.select("session_date", "dark_hours", (seconds / 3600).alias("integration_hours"), F.least(F.lit(100.0), seconds / (F.col("dark_hours") * 3600) * 100).alias("efficiency_pct"))


def efficiency_overview(nights: DataFrame) -> DataFrame:
    """One row: mean efficiency of the nights above zero, best night (the earliest of equal ones) and its efficiency, dark and integration hours in all."""
    above = F.when(F.col("efficiency_pct") > 0, F.col("efficiency_pct"))
    best = F.struct(above, -F.unix_date("session_date"))
    return nights.agg(F.avg(above).alias("mean_efficiency"), F.max_by("session_date", F.when(above.isNotNull(), best)).alias("best_night"), F.max(above).alias("best_efficiency"), F.sum("dark_hours").alias("total_dark"), F.sum("integration_hours").alias("total_integration"))


def weather_at(hourly: DataFrame, date: str, by: list[str], hour: int) -> DataFrame:
    """For each date the row of ``hour``, else of the first of HOURS_INSTEAD that is there, else the last up to place ``hour`` in order."""
    wanted = F.array(*map(F.lit, (hour, *(h for h in HOURS_INSTEAD if h != hour))))
    listed = F.nullif(F.array_position(wanted, F.hour("timestamp")), F.lit(0))
    keys = [*by, date]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")) - 1
    ranked = hourly.withColumn("_place", place).withColumn("_rank", F.coalesce(listed, F.when(F.col("_place") <= hour, 10_000 - F.col("_place")), F.lit(99_999)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "timestamp"))
    return ranked.withColumn("_r", first).where("_r = 1").drop("_r", "_rank", "_place")


def explode_hourly(json: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Rows (place, time, ``names``) of stored forecasts whose ``column`` is JSON with an object ``hourly`` of arrays; a shorter array gives nulls."""
    schema = "hourly struct<time: array<string>, " + ", ".join(f"{n}: array<double>" for n in names) + ">"
    parsed = json.withColumn("_h", F.from_json(column, schema)["hourly"])
    zipped = parsed.withColumn("_z", F.explode(F.arrays_zip(*(F.col(f"_h.{n}").alias(n) for n in ("time", *names)))))
    return zipped.select(*json.columns, F.col("_z.time").alias("time"), *(F.col(f"_z.{n}").alias(n) for n in names)).where("time is not null")
