"""Operators over ordered rows: segments, series, streaks and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sky
from ..plans.durable import durable
from .joins import dealt_lists, spread_lists
from .selection import numbered


def segment_jumps(samples: DataFrame, ra_hours: float = 0.25, dec_degrees: float = 2.0) -> DataFrame:
    """Numbers each session's segments from 0: a new one where RA (over 24 h) or DEC moves by more between two samples."""
    order = Window.partitionBy("session_id").orderBy("timestamp", "sample_id")
    ra = F.abs(F.col("ra_hours") - F.lag("ra_hours").over(order))
    jump = (F.least(ra, 24 - ra) > ra_hours) | (F.abs(F.col("dec_degrees") - F.lag("dec_degrees").over(order)) > dec_degrees)
    flagged = samples.withColumn("_jump", F.coalesce(jump.cast("int"), F.lit(0)))
    return flagged.withColumn("segment", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def deviations(segments: DataFrame) -> DataFrame:
    """Arc seconds off the segment's median position for tracking samples, 0 for others."""
    on = F.col("status") == "TRACKING"
    keys = ["session_id", "segment"]
    middle = segments.where(on).groupBy(*keys).agg(F.expr("percentile(ra_hours, 0.5)").alias("_ra"), F.expr("percentile(dec_degrees, 0.5)").alias("_dec"))
    wide = F.greatest(F.cos(F.radians("_dec")), F.lit(0.01))
    joined = segments.join(middle, keys, "left")
    return joined.select(*segments.columns, F.when(on, (F.col("ra_hours") - F.col("_ra")) * 54000 * wide).otherwise(0.0).alias("ra_off"), F.when(on, (F.col("dec_degrees") - F.col("_dec")) * 3600).otherwise(0.0).alias("dec_off"))


def latest_per(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def timeline(samples: DataFrame, most: int) -> DataFrame:
    """Every n-th sample of a session, so that about ``most`` are left."""
    by = Window.partitionBy("session_id")
    placed = samples.withColumn("_r", F.row_number().over(by.orderBy("timestamp", "sample_id"))).withColumn("_n", F.count("*").over(by))
    return placed.where((F.col("_r") - 1) % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_r", "_n")


def nightly_series(exposures: DataFrame, metric: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Median by night, with averages over the last so many observed nights where there are as many."""
    nights = exposures.groupBy("session_date").agg(F.expr(f"percentile(`{metric}`, 0.5)").alias("median"))
    order = Window.orderBy("session_date")  # one row for each night
    number = F.row_number().over(order)
    return nights.select("session_date", "median", *(F.when(number >= w, F.avg("median").over(order.rowsBetween(1 - w, 0))).alias(f"avg_{w}") for w in windows))


def longest_streak(observations: DataFrame) -> DataFrame:
    """First, last and number of the longest run of consecutive nights; ties to the earlier."""
    nights = observations.select("observation_date").where("observation_date is not null").distinct()
    runs = nights.withColumn("_run", F.expr("date_sub(observation_date, cast(row_number() over (order by observation_date) as int))"))
    return runs.groupBy("_run").agg(F.min("observation_date").alias("first_night"), F.max("observation_date").alias("last_night"), F.count("*").alias("nights")).orderBy(F.desc("nights"), "first_night").limit(1).drop("_run")


def year_heatmap(observations: DataFrame, year: int) -> DataFrame:
    """Every day of the year by week and weekday (Monday is 0), with its hours."""
    days = observations.sparkSession.sql(f"select explode(sequence(date'{year}-01-01', date'{year}-12-31')) as day")
    hours = observations.groupBy("observation_date").agg((F.sum("exposure_time") / 3600).alias("hours"))
    start = F.weekday(F.lit(f"{year}-01-01").cast("date"))
    return days.join(hours, F.col("day") == F.col("observation_date"), "left").select("day", F.floor((F.dayofyear("day") - 1 + start) / 7).cast("int").alias("week"), F.weekday("day").alias("weekday"), F.coalesce("hours", F.lit(0.0)).alias("hours"))


def top_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def brightest_per_cell(stars: DataFrame, width: float, height: float, cells: int, k: int) -> DataFrame:
    cell = lambda c, size: F.least(F.floor(F.col(c) / (size / cells)), F.lit(cells - 1)).cast("int")
    placed = stars.withColumn("cx", cell("x", width)).withColumn("cy", cell("y", height))
    return top_per(placed, ["frame", "cx", "cy"], [F.desc("flux"), "star"], k)


def flag_rejections(frames: DataFrame, batch: list[str], least_score: float = 30.0, eccentricity: float = 0.7, least_stars: int = 10, factor: float = 2.0) -> DataFrame:
    """Reasons why a frame is left out: score, eccentricity, stars, trail, and an FWHM over ``factor`` times the batch's median (of values above 0)."""
    middle = frames.where("fwhm > 0").groupBy(*batch).agg(F.expr("percentile(fwhm, 0.5)").alias("_median"))
    reasons = F.array(F.when(F.col("score") < least_score, F.lit("score")), F.when(F.col("eccentricity") > eccentricity, F.lit("eccentricity")), F.when(F.col("n_stars") < least_stars, F.lit("stars")), F.when(F.col("trailed"), F.lit("trail")), F.when(F.col("fwhm") > factor * F.col("_median"), F.lit("fwhm")))
    marked = frames.join(middle, batch, "left").withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ","))
    return marked.withColumn("rejected", F.col("reasons") != "").drop("_median")


def best_and_worst(rows: DataFrame, column: str, ids: list[str], n: int) -> DataFrame:
    """The ``n`` smallest and largest of ``column`` (nulls left out; ties by ``ids``) as ``ids``, measure and kind (low, high)."""
    known = rows.where(F.col(column).isNotNull())
    pick = lambda kind, order: known.orderBy(order, *ids).limit(n).select(*ids, F.lit(column).alias("measure"), F.lit(kind).alias("kind"))
    return pick("low", F.col(column)).unionByName(pick("high", F.col(column).desc()))


def unique_names(plan: DataFrame, name: str, order: str) -> DataFrame:
    """The second and later rows of one name get the suffix _2, _3 ..."""
    numbers = numbered(plan, [name], [order], "_number")
    return numbers.select(*plan.columns, F.when(F.col("_number") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_number").cast("string"))).alias("unique_name"))


def orphan_matches(targets: DataFrame) -> DataFrame:
    """(orphan_id, match_id): targets without a canonical name whose name is another's, runs of spaces counting as one.

    All pairs of a name are asked for. Ids meet as lists (see ``dealt_lists``), pairs of lists are spread evenly over as many tasks as the pairs of ids need, and only there
    taken apart; so a name of many targets is neither one task nor a buffer that is read for each orphan.
    """
    squeezed = lambda c: F.regexp_replace(c, " +", " ")
    blank = F.coalesce("canonical_name", F.lit("")) == ""
    orphans = targets.where(blank).select(F.col("id").alias("orphan_id"), squeezed("name").alias("k"))
    named = targets.where(~blank).select(F.col("id").alias("match_id"), squeezed("canonical_name").alias("k"))
    sides = [durable(dealt_lists(rows, "k", ident)) for rows, ident in ((orphans, "orphan_id"), (named, "match_id"))]
    both = sides[0].withColumnRenamed("ids", "orphans").join(sides[1].withColumnRenamed("ids", "matches").hint("merge"), "k")
    spread = spread_lists(both.select("orphans", "matches"), "orphans", "matches")
    # generated code holds all rows that one input row makes until they are taken. A coalesce that leaves the partitions as they are ends it, so a row makes those of one orphan and a list, not of two lists
    each = spread.select("matches", F.explode("orphans").alias("orphan_id")).coalesce(2**31 - 1)
    return each.select("orphan_id", F.explode("matches").alias("match_id")).where("orphan_id <> match_id")


def night_weather(hourly: DataFrame) -> DataFrame:
    """Nights from 20:00 to 05:59, dated by their evening: averages, cloud range, the highest chance and the sum of rain, clear hours (cloud under 25), class, seeing
    and imaging score. Nights without a cloud value are left out."""
    hour = F.hour("timestamp")
    rows = hourly.where((hour >= 20) | (hour < 6)).withColumn("night", F.to_date(F.col("timestamp") - F.expr("INTERVAL 6 HOURS")))
    mean = {"temperature": "temperature", "cloud_cover": "cloud", "wind_speed": "wind", "humidity": "humidity", "dewpoint": "dewpoint"}
    found = rows.groupBy("night").agg(
        *(F.avg(c).alias(n) for c, n in mean.items()), F.min("cloud_cover").alias("cloud_min"), F.max("cloud_cover").alias("cloud_max"), F.max("precipitation_probability").alias("precipitation_prob"), F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("precipitation").alias("_rain"), F.count(F.when(F.col("cloud_cover") < 25, 1)).alias("clear_hours"), F.count("cloud_cover").alias("total_hours"),
    ).where("total_hours > 0")
    parts = [F.col(c) for c in ("cloud", "wind", "humidity", "temperature", "dewpoint")]
    out = found.withColumn("classification", sky.classify_weather(F.col("cloud"), F.col("_rain"))).withColumn("seeing_quality", sky.seeing_quality(*parts))
    return out.withColumn("imaging_score", sky.imaging_score(*parts, F.col("clear_hours") / F.col("total_hours"))).drop("_rain")
