"""Grouped statistics over observations, exposures, mount samples, frames and stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import joined_by, order_statistics

SEEN = lambda c: F.when(F.col(c) > 0, F.col(c))  # noqa: E731  a measure of zero is a missing one


def blank_to_null(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def names(c: str) -> Column:
    """Distinct values as a sorted, comma-separated list."""
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def global_stats(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: counts of both tables, totals, dates, distinct values, averages of the measures above zero."""
    t = targets.agg(F.count("*").alias("n_targets"))
    o = observations.agg(
        F.count("*").alias("n_observations"), F.coalesce(F.sum("exposure_time"), F.lit(0.0)).alias("total_exposure"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("total_frames"),
        F.countDistinct("observation_date").alias("n_nights"), F.countDistinct("filter").alias("n_filters"), F.countDistinct(blank_to_null("telescope")).alias("n_telescopes"), F.countDistinct(blank_to_null("camera")).alias("n_cameras"),
        F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), F.avg(SEEN("hfr")).alias("avg_hfr"), F.avg(SEEN("fwhm")).alias("avg_fwhm"),
    )
    return t.crossJoin(o)


def target_totals(observations: DataFrame) -> DataFrame:
    return observations.groupBy("target_id").agg(F.coalesce(F.sum("exposure_time"), F.lit(0.0)).alias("total_exposure"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("total_frames"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"))


def target_rankings(targets: DataFrame, observations: DataFrame, n: int) -> DataFrame:
    """Targets by total exposure, those without observations too; the first ``n``, ties to smaller ids."""
    o = observations.groupBy("target_id").agg(F.sum("exposure_time").alias("e"), F.sum("frame_count").alias("f"), F.countDistinct("observation_date").alias("nights"), F.countDistinct("filter").alias("filters"), names("telescope").alias("telescopes"))
    joined = targets.select("id", "name").join(o, F.col("id") == F.col("target_id"), "left")
    return joined.select("id", "name", F.coalesce("e", F.lit(0.0)).alias("total_exposure"), F.coalesce("f", F.lit(0)).alias("total_frames"), F.coalesce("nights", F.lit(0)).alias("nights"), F.coalesce("filters", F.lit(0)).alias("filters"), F.coalesce("telescopes", F.lit("")).alias("telescopes")).orderBy(F.desc("total_exposure"), "id").limit(n)


def breakdown(observations: DataFrame, *keys: str | Column) -> DataFrame:
    """Exposure, frames, nights, average sub-exposure and quality for each value of the keys."""
    return observations.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("exposure_time").alias("total_exposure"), F.sum("frame_count").alias("total_frames"), F.countDistinct("observation_date").alias("nights"),
        (F.sum("exposure_time") / F.nullif(F.sum("frame_count"), F.lit(0))).alias("avg_sub"), F.min(SEEN("hfr")).alias("best_hfr"), F.avg(SEEN("hfr")).alias("avg_hfr"), F.avg(SEEN("fwhm")).alias("avg_fwhm"),
    )


def equipment_stats(observations: DataFrame, *keys: str) -> DataFrame:
    """``breakdown`` without rows whose keys are null or blank."""
    return breakdown(observations.where(" and ".join(f"coalesce(trim(`{k}`), '') <> ''" for k in keys)), *keys)


def period_stats(observations: DataFrame, period: str) -> DataFrame:
    """By 'month' (yyyy-MM) or 'year' (yyyy)."""
    label = F.date_format("observation_date", {"month": "yyyy-MM", "year": "yyyy"}[period]).alias("period")
    return observations.groupBy(label).agg(F.sum("exposure_time").alias("total_exposure"), F.sum("frame_count").alias("total_frames"), F.countDistinct("observation_date").alias("nights"), F.countDistinct("target_id").alias("targets"))


def dow_stats(observations: DataFrame) -> DataFrame:
    """By day of week, Sunday is 0."""
    return observations.groupBy((F.dayofweek("observation_date") - 1).alias("dow")).agg(F.count("*").alias("n"), F.sum("exposure_time").alias("total_exposure"))


def activity_calendar(observations: DataFrame, year: int | None = None) -> DataFrame:
    rows = observations if year is None else observations.where(F.year("observation_date") == year)
    return rows.groupBy("observation_date").agg((F.sum("exposure_time") / 3600).alias("hours"))


def quality_trend(observations: DataFrame) -> DataFrame:
    return observations.where("hfr > 0").groupBy(F.date_format("observation_date", "yyyy-MM").alias("month")).agg(F.avg("hfr").alias("avg_hfr"), F.avg(SEEN("fwhm")).alias("avg_fwhm"), F.count("*").alias("n"))


def object_type_stats(targets: DataFrame, observations: DataFrame) -> DataFrame:
    label = F.coalesce("object_type", F.lit("Unknown")).alias("object_type")
    totals = observations.groupBy("target_id").agg(F.sum("exposure_time").alias("e"))
    return targets.select("id", label).join(totals, F.col("id") == F.col("target_id"), "left").groupBy("object_type").agg(F.count("*").alias("n_targets"), F.coalesce(F.sum("e"), F.lit(0.0)).alias("total_exposure"))


def session_summary(exposures: DataFrame) -> DataFrame:
    return exposures.groupBy("session_date").agg(
        F.count("*").alias("n_exposures"), F.countDistinct("target_name").alias("n_targets"), F.sum("exposure_seconds").alias("total_seconds"), F.avg("hfr").alias("avg_hfr"), F.avg("fwhm").alias("avg_fwhm"),
        names("target_name").alias("targets"), names("filter_name").alias("filters"), names("telescope").alias("telescopes"), F.min("timestamp").alias("first_exposure"), F.max("timestamp").alias("last_exposure"),
    )


def equipment_performance(exposures: DataFrame) -> DataFrame:
    """Exact medians by telescope, camera and filter; frame_count is the larger number of measures, at least 1."""
    keys = ["telescope", "camera", "filter_name"]
    rows = exposures.withColumn("filter_name", F.coalesce("filter_name", F.lit("Unknown"))).withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in keys[:2]})
    sums = rows.groupBy(*keys).agg(F.min("hfr").alias("best_hfr"), F.greatest(F.count("hfr"), F.count("fwhm"), F.lit(1)).alias("frame_count"), F.sum("exposure_seconds").alias("total_seconds"))
    return joined_by(sums, order_statistics(rows, keys, {"median_hfr": ("hfr", 0.5), "median_fwhm": ("fwhm", 0.5)}), keys)


def equipment_performance_obs(observations: DataFrame) -> DataFrame:
    """By telescope, camera and filter: rows, upper medians of HFR and FWHM, best HFR. Rows without a telescope or camera are left out; a blank filter is 'Unknown'."""
    keys = ["telescope", "camera", "filter"]
    blank = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    rows = observations.where("telescope is not null and camera is not null").withColumns({c: blank(c) for c in keys})
    out = rows.groupBy(*keys).agg(F.count("*").alias("frame_count"), F.min("hfr").alias("best_hfr"))
    return joined_by(out, order_statistics(rows, keys, {"median_hfr": ("hfr", "upper"), "median_fwhm": ("fwhm", "upper")}), keys)


def tracking_stats(samples: DataFrame) -> DataFrame:
    """Counts, share of tracking, and spread of the tracking samples, in one pass."""
    on = F.col("status") == "TRACKING"
    of = lambda c: F.when(on, F.col(c))
    return samples.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count(F.when(on, 1)).alias("n_tracking"), (F.count(F.when(on, 1)) * 100.0 / F.count("*")).alias("tracking_percent"), F.avg(of("ra_stdev")).alias("avg_ra"), F.avg(of("dec_stdev")).alias("avg_dec"),
        F.min(of("ra_stdev")).alias("min_ra"), F.max(of("ra_stdev")).alias("max_ra"), F.sqrt(F.avg(of("ra_stdev") * F.col("ra_stdev"))).alias("rms_ra"), F.sqrt(F.avg(of("dec_stdev") * F.col("dec_stdev"))).alias("rms_dec"),
    )


def frame_metrics(stars: DataFrame) -> DataFrame:
    median = lambda c: F.expr(f"percentile({c}, 0.5)")
    return stars.groupBy("frame").agg(F.count("*").alias("n_stars"), median("fwhm").alias("fwhm"), median("hfr").alias("hfr"), median("eccentricity").alias("eccentricity"), median("snr").alias("snr"), F.stddev_pop("fwhm").alias("fwhm_std"))


def trail_flag(stars: DataFrame, least: int = 5, cut: float = 0.5) -> DataFrame:
    """Whether a frame's stars point one way: squared length of the mean doubled angle above ``cut``, of ``least`` stars at least."""
    twice = F.radians(F.col("theta") * 2)
    sums = stars.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.cos(twice)).alias("c"), F.sum(F.sin(twice)).alias("s"))
    r2 = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))
    return sums.select("frame", "n", r2.alias("r2"), ((F.col("n") >= least) & (r2 > cut)).alias("trailed"))


def region_stats(stars: DataFrame, width: float, height: float) -> DataFrame:
    """FWHM of a 3 x 3 grid of regions; empty regions are rows too."""
    cell = lambda c, size: F.least(F.floor(F.col(c) / (size / 3)), F.lit(2)).cast("int")
    placed = stars.select(cell("y", height).alias("row"), cell("x", width).alias("col"), "fwhm")
    found = placed.groupBy("row", "col").agg(F.count("*").alias("n"), F.min("fwhm").alias("min_fwhm"), F.max("fwhm").alias("max_fwhm"), F.avg("fwhm").alias("mean_fwhm"), F.stddev_pop("fwhm").alias("std_fwhm"))
    middle = medians(placed, ["row", "col"], "fwhm", "median_fwhm")
    grid = stars.sparkSession.range(9).select(F.floor(F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"))
    return grid.join(found, ["row", "col"], "left").join(middle, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def medians(rows: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Exact medians by ``keys`` (linear between the two middle values), for groups of any size."""
    return order_statistics(rows, keys, {out: (column, 0.5)})


def batch_summary(scored: DataFrame, batch: str) -> DataFrame:
    """By ``batch``: frames, mean, median and spread of the score, median FWHM, and the frames of the best and the worst score (to nine places; ties to the smaller frame)."""
    score = F.round("score", 9)
    sums = scored.groupBy(batch).agg(
        F.count("*").alias("frames"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.min_by("frame", F.struct(-score, "frame")).alias("best_frame"), F.min_by("frame", F.struct(score, "frame")).alias("worst_frame"),
    )
    return joined_by(sums, order_statistics(scored, [batch], {"median_score": ("score", 0.5), "median_fwhm": ("fwhm", 0.5)}), [batch])


def dominant_filter(observations: DataFrame) -> DataFrame:
    """The filter with the most frames of each target; ties to the first by name."""
    sums = observations.where("filter is not null").groupBy("target_id", "filter").agg(F.sum("frame_count").alias("frames"))
    first = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("frames"), "filter"))
    return sums.withColumn("r", first).where("r = 1").drop("r")


CALIBRATION_WORDS = ("dark", "flat", "bias", "offset", "calib")


def storage_breakdown(files: DataFrame, processed: Column) -> DataFrame:
    """By format: files, bytes, those in calibration folders, and of XISF files those that can be compressed anew (not ``processed``)."""
    kind = F.regexp_extract(F.lower("path"), r"(\.fits\.fz|\.[a-z]+)$", 1)
    folders = F.split(F.lower("path"), "/")
    shelf = F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda x: x.rlike("|".join(CALIBRATION_WORDS)))
    size = F.col("length")
    return files.groupBy(kind.alias("format")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.count(F.when(shelf, 1)).alias("calibration_files"), F.sum(F.when(shelf, size).otherwise(0)).alias("calibration_bytes"), F.sum(F.when((kind == ".xisf") & ~processed, size).otherwise(0)).alias("recompressible"))


def exposure_details(frames: DataFrame) -> DataFrame:
    """Frames by target, day, filter and exposure, beside the day's total."""
    per = frames.where("image_type = 'LIGHT'").groupBy("target", F.to_date("date_obs").alias("night"), "filter", "exposure").agg(F.count("*").alias("n"))
    return per.withColumn("night_seconds", F.sum(F.col("n") * F.col("exposure")).over(Window.partitionBy("target", "night")))


def validation_warnings(frames: DataFrame, matches: DataFrame, least: int = 5, tolerance: float = 2.0) -> DataFrame:
    """(target, filter, rule, detail) of what an export lacks: few frames, no object, no darks, dark temperature, no flats, no biases, mixed cameras, mixed telescopes.

    ``matches`` has, for each target and filter, n_dark_candidates, dark_gap (degrees of the nearest dark), n_flats and n_biases.
    """
    light = frames.where("image_type = 'LIGHT'")
    groups = joined_by(light.groupBy("target", "filter").agg(F.count("*").alias("n")), matches, ["target", "filter"])
    none = F.lit(0).cast("double")
    checks = [
        (F.col("n") < least, "few frames", F.col("n").cast("double")), (F.coalesce("target", F.lit("Unknown")) == "Unknown", "no object", F.col("n").cast("double")), (F.col("n_dark_candidates") == 0, "no darks", none),
        ((F.col("n_dark_candidates") > 0) & (F.col("dark_gap") > tolerance), "dark temperature", F.col("dark_gap")), (F.col("n_flats") == 0, "no flats", none), (F.col("n_biases") == 0, "no biases", none),
    ]
    rules = F.array(*(F.when(test, F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for test, name, detail in checks))
    single = groups.select("target", "filter", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("target", "filter", "r.rule", "r.detail")
    setups = light.groupBy("target").agg(F.countDistinct("camera").alias("c"), F.countDistinct("telescope").alias("t"))
    mixed = F.array(*(F.when(F.col(c) > 1, F.struct(F.lit(name).alias("rule"), F.col(c).cast("double").alias("detail"))) for c, name in (("c", "mixed cameras"), ("t", "mixed telescopes"))))
    whole = setups.select("target", F.lit(None).cast("string").alias("filter"), F.explode(F.filter(mixed, lambda r: r.isNotNull())).alias("r")).select("target", "filter", "r.rule", "r.detail")
    return single.unionByName(whole)
