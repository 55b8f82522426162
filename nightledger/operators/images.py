"""Statistics of pixel tables (image_id, x, y, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import joined_by, order_statistics


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Pixels in equal bins between each image's smallest and largest value."""
    ends = pixels.groupBy("image_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return pixels.join(ends, "image_id").groupBy("image_id", place.alias("bin")).agg(F.count("*").alias("n"))


def background_subtracted(pixels: DataFrame, signal: str, background: str) -> DataFrame:
    """Mean and spread of the signal region less the median of the background region, for each image."""
    of = lambda region: F.when(F.expr(region), F.col("value"))
    marked = pixels.withColumns({"_s": of(signal), "_b": of(background)})
    sums = joined_by(marked.groupBy("image_id").agg(F.avg("_s").alias("m"), F.stddev_samp("_s").alias("spread")), order_statistics(marked, ["image_id"], {"background": ("_b", 0.5)}), ["image_id"])
    return sums.select("image_id", (F.col("m") - F.col("background")).alias("signal"), "background", "spread", ((F.col("m") - F.col("background")) / F.nullif(F.col("spread"), F.lit(0.0))).alias("snr"))


def mtf(c: Column, m: Column) -> Column:
    """Midtones transfer: 0, m and 1 become 0, one half and 1."""
    return F.when(c <= 0, 0.0).when(c >= 1, 1.0).otherwise((m - 1) * c / ((2 * m - 1) * c - m))


def compare_series(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """RMSE, mean absolute error and correlation of two series, each scaled to 0 .. 1, where both have a key."""
    def scaled(rows: DataFrame, name: str) -> DataFrame:
        ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        return rows.crossJoin(F.broadcast(ends)).select(key, ((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias(name))  # the ends are one row

    both = scaled(a, "a").join(scaled(b, "b"), key)
    gap = F.col("a") - F.col("b")
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.corr("a", "b").alias("r"))


def compare_profiles(a: DataFrame, b: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """By group: n, rmse, mae, r, peak_diff and mean_diff of two series, each scaled to 0 .. 1; ``key`` counts from 0 in each.

    The shorter series is interpolated linearly at the places of the longer. A constant series is 0 everywhere, and its
    correlation is 0. Groups that only one side has are left out. Points meet by (group, place), so a long series is spread over tasks.
    """
    length = lambda rows, name: rows.groupBy(by).agg(F.count("*").alias(name))
    lengths = length(a, "_a").join(length(b, "_b"), by).withColumn("_n", F.greatest("_a", "_b"))

    def scaled(rows: DataFrame, own: str, name: str) -> DataFrame:
        after = rows.select(by, (F.col(key) - 1).alias(key), F.col(value).alias("_after"))
        points = rows.select(by, key, value).join(after, [by, key], "left").join(lengths.select(by, F.col(own).alias("_m"), "_n"), by)
        step = (F.col("_n") - 1) / F.nullif(F.col("_m") - 1, F.lit(0))  # places of the longer series a point
        last = F.col(key) == F.col("_m") - 1
        begin = F.when(F.col("_m") == 1, F.lit(0)).otherwise(F.ceil(F.col(key) * (F.col("_n") - 1) / F.nullif(F.col("_m") - 1, F.lit(0))))
        end = F.when(last, F.col("_n") - 1).otherwise(F.ceil((F.col(key) + 1) * (F.col("_n") - 1) / F.nullif(F.col("_m") - 1, F.lit(0))) - 1)
        placed = points.withColumn("_place", F.explode(F.sequence(begin.cast("long"), end.cast("long"))))
        at = placed.select(by, "_place", F.when(last, F.col(value)).otherwise(F.col(value) + (F.col("_after") - F.col(value)) * (F.col("_place") / step - F.col(key))).alias("_v"))
        ends = at.groupBy(by).agg(F.min("_v").alias("_lo"), (F.max("_v") - F.min("_v")).alias("_span"))
        return at.join(ends, by).select(by, "_place", F.when(F.col("_span") < 1e-15, 0.0).otherwise((F.col("_v") - F.col("_lo")) / F.col("_span")).alias(name))

    gap = F.col("u") - F.col("v")
    spread = F.when((F.stddev_pop("u") >= 1e-15) & (F.stddev_pop("v") >= 1e-15), F.stddev_pop("u") * F.stddev_pop("v"))
    sums = [F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.coalesce(F.covar_pop("u", "v") / spread, F.lit(0.0)).alias("r"), (F.max("u") - F.max("v")).alias("peak_diff"), (F.avg("u") - F.avg("v")).alias("mean_diff")]
    return scaled(a, "_a", "u").join(scaled(b, "_b", "v"), [by, "_place"]).groupBy(by).agg(*sums)
