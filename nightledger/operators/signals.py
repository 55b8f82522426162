"""Correlation, tests, attenuation and image statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import order_statistics

Z95 = 1.959963984540054  # the normal quantile of 0.975


def two_sided_p(t: Column, df: Column, points: int = 600) -> Column:
    """The chance of a t as far from 0 or farther, by Simpson's rule over the angle atan(t / sqrt(df)); null for a null t."""
    edge = F.least(F.lit(math.pi / 2), 14 / F.sqrt(df))

    def area(to: Column) -> Column:
        step = to / points
        terms = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.when((i == 0) | (i == points), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.pow(F.cos(i * step), df - 1))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * step / 3

    angle = F.least(F.atan(F.abs(t) / F.sqrt(df)), edge)
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), 1 - area(angle) / area(edge)))


def t_quantile_95(df: Column) -> Column:
    """The t quantile of 0.975 by its expansion in 1 / df; within 0.0002 from 9 degrees on."""
    z = Z95
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)


def mean_ranks(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """``by``, ``column`` and ``out``: the mean rank of each distinct value. Equal values are counted before they are ordered, so ties cost nothing; values are
    ranked inside ranges of equal width, and the ranges' sizes are added up, so no group is sorted in one task."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    ends = counts.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    placed = counts.join(ends, by).withColumn("_range", F.coalesce(F.least(F.floor((F.col(column) - F.col("_lo")) / width * 1024), F.lit(1023)), F.lit(0)))
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))  # 1,024 rows a group
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(before.drop("_size"), [*by, "_range"]).withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return ranked.select(*by, column, (F.coalesce("_before", F.lit(0)) + F.col("_in") + (F.col("_n") + 1) / 2).alias(out))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by`` and rho: the correlation of mean ranks of the rows with both values, taken over distinct pairs with their counts."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*by, x, y).agg(F.count("*").alias("_w"))
    joined = pairs.join(mean_ranks(both, by, x, "_a"), [*by, x]).join(mean_ranks(both, by, y, "_b"), [*by, y])
    s = lambda e: F.sum(F.col("_w") * e)
    a, b = F.col("_a"), F.col("_b")
    sums = joined.groupBy(*by).agg(F.sum("_w").alias("n"), s(a).alias("sa"), s(b).alias("sb"), s(a * a).alias("aa"), s(b * b).alias("bb"), s(a * b).alias("ab"))
    n = F.col("n")
    spread = F.sqrt((F.col("aa") - F.col("sa") * F.col("sa") / n) * (F.col("bb") - F.col("sb") * F.col("sb") / n))
    return sums.select(*by, "n", ((F.col("ab") - F.col("sa") * F.col("sb") / n) / F.nullif(spread, F.lit(0.0))).alias("rho"))


def correlation_p(r: Column, n: Column) -> Column:
    """The p-value of a correlation of n pairs; 0 for a perfect one, null under three pairs."""
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(two_sided_p(t, (n - 2).cast("double")))


def regression_band(df: DataFrame, x: str, y: str, points: int = 100, least: int = 11) -> DataFrame:
    """place, x, fitted and half_width of the 95 % band of the regression line at ``points`` places from the least to the largest x; no rows under ``least`` pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = both.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where(F.col("n") >= least)
    at = one.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("place") / (points - 1))
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2))
    half = t_quantile_95((F.col("n") - 2).cast("double")) * error * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), F.lit(2)) / F.col("sxx"))
    return at.select("place", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("fitted"), half.alias("half_width"))


def region_measures(pixels: DataFrame, signal: str, background: str, readnoise: float = 0.0) -> DataFrame:
    """By image: statistics of the signal region less the background's median, and the SNR of the photon and of the flux model.

    ``signal`` and ``background`` are conditions on x and y. Photon: mean over the root of it, the background's mean (neither under 0) and the squared read noise. Flux:
    difference of means over the background's spread. A zero noise gives 0.
    """
    sky = pixels.where(background)
    middle = sky.groupBy("image_id").agg(F.avg("value").alias("bg_mean"), F.stddev_samp("value").alias("bg_std")).join(order_statistics(sky, ["image_id"], {"bg": ("value", 0.5)}), "image_id")
    part = pixels.where(signal).join(middle, "image_id")
    less = F.col("value") - F.col("bg")
    sums = part.groupBy("image_id").agg(
        F.avg(less).alias("mean"), F.stddev_pop(less).alias("std"), F.min(less).alias("min"), F.max(less).alias("max"), F.count("*").alias("n"), F.var_samp(less).alias("var"),
        F.avg("value").alias("raw_mean"), F.first("bg_mean").alias("bg_mean"), F.first("bg_std").alias("bg_std"),
    )
    sums = sums.join(order_statistics(part.select("image_id", less.alias("_less")), ["image_id"], {"median": ("_less", 0.5)}), "image_id")
    noise = F.sqrt(F.greatest(F.col("mean"), F.lit(0.0)) + F.greatest(F.col("bg_mean"), F.lit(0.0)) + readnoise**2)
    return sums.withColumns({"snr_photon": F.when(noise > 0, F.col("mean") / noise).otherwise(0.0), "snr_flux": F.when(F.col("bg_std") > 0, (F.col("raw_mean") - F.col("bg_mean")) / F.col("bg_std")).otherwise(0.0)})


def attenuation(reference: Column, other: Column) -> tuple[Column, Column]:
    """(per cent, magnitudes) that the second median lacks of the first; 0 where one is not above 0."""
    both = (reference > 0) & (other > 0)
    return F.when(both, (1 - other / reference) * 100).otherwise(0.0), F.when(both, -2.5 * F.log10(other / reference)).otherwise(0.0)


def exposure_factor(a: Column, b: Column) -> Column:
    """How many times as long the second must be exposed for the first's SNR; 0 where one is not above 0."""
    return F.when((a > 0) & (b > 0), F.pow(a / b, F.lit(2))).otherwise(0.0)


def compare_images(measures: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a, b) of images with ``region_measures``: attenuation, Welch's t with its degrees, p and Cohen's d, exposure factors of both models."""
    side = lambda k: measures.select(*(F.col(c).alias(k if c == "image_id" else f"{c}_{k}") for c in measures.columns))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    lost, magnitude = attenuation(F.col("median_a"), F.col("median_b"))
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0))
    df = (ea + eb) * (ea + eb) / F.nullif(ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1), F.lit(0.0))
    out = both.select("a", "b", lost.alias("attenuation_pct"), magnitude.alias("attenuation_mag"), t.alias("t"), df.alias("df"), ((F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt((F.col("var_a") + F.col("var_b")) / 2), F.lit(0.0))).alias("cohen_d"), exposure_factor(F.col("snr_photon_a"), F.col("snr_photon_b")).alias("exposure_factor_photon"), exposure_factor(F.col("snr_flux_a"), F.col("snr_flux_b")).alias("exposure_factor_flux"))
    return out.withColumn("p", two_sided_p(F.col("t"), F.col("df")))


def image_percentiles(pixels: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """image_id, share and value: exact percentiles of each image, whatever its size."""
    found = order_statistics(pixels, ["image_id"], {f"p{k}": ("value", s) for k, s in enumerate(shares)})
    return found.select("image_id", F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"p{k}").alias("value")) for k, s in enumerate(shares)))).alias("x")).select("image_id", "x.share", "x.value")


def stretch(pixels: DataFrame, low: float = 0.0005, high: float = 0.9995, shadow: float = 2.8, target: float = 0.25) -> DataFrame:
    """By image: clip percentiles lo and hi, and of the values scaled between them the median, MAD, shadow and midtone. A constant image has 0, 0, 0 and 0.5."""
    ends = order_statistics(pixels, ["image_id"], {"lo": ("value", low), "hi": ("value", high)})
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    scaled = pixels.join(ends, "image_id").withColumn("v", F.coalesce((F.greatest("lo", F.least("hi", F.col("value"))) - F.col("lo")) / width, F.lit(0.0)))
    middle = order_statistics(scaled, ["image_id"], {"median": ("v", 0.5)})
    away = scaled.join(middle, "image_id").withColumn("_away", F.abs(F.col("v") - F.col("median")))
    mad = ends.join(middle, "image_id").join(order_statistics(away, ["image_id"], {"mad": ("_away", 0.5)}), "image_id")
    dark = F.greatest(F.lit(0.0), F.col("median") - shadow * F.col("mad"))
    x = (F.col("median") - F.col("shadow")) / (1 - F.col("shadow"))
    midtone = F.when((x <= 0) | (x >= 1), 0.5).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.999), (target * x - x) / (2 * target * x - target - x))))
    return mad.withColumn("shadow", dark).withColumn("midtone", F.coalesce(midtone, F.lit(0.5)))


def metric_points(frames: DataFrame, key: str, x: str, y: str, stars: str | None = None) -> DataFrame:
    """key, x and y of the frames that a scatter chart of two metrics shows: both known, and some stars where ``stars`` names their number."""
    shown = frames.where(F.col(stars) > 0) if stars else frames
    return shown.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).alias("x"), F.col(y).alias("y"))


def metric_histogram(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    """bin, low and n of min(most, max(5, n div 3)) equal bins."""
    one = df.where(F.col(column).isNotNull()).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.least(F.lit(most), F.greatest(F.lit(5), F.floor(F.count("*") / 3))).cast("int").alias("bins"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.coalesce(F.least(F.floor((F.col(column) - F.col("lo")) / width * F.col("bins")), F.col("bins") - 1), F.lit(0)).cast("int")
    counted = df.where(F.col(column).isNotNull()).join(F.broadcast(one)).groupBy(place.alias("bin"), "lo", "hi", "bins").agg(F.count("*").alias("n"))  # the ends are one row
    return counted.select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.col("bins")).alias("low"), "n")
