"""Column expressions for weather, image quality and sky geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cloud classes by their upper bounds in per cent.
CLOUDS = (("Clear", 10), ("Mostly Clear", 25), ("Partly Cloudy", 50), ("Mostly Cloudy", 75), ("Overcast", 100))
# Weights of the quality score, and the values that count 100 and 0.
WEIGHTS = {"fwhm": 0.35, "eccentricity": 0.20, "snr": 0.20, "stars": 0.15, "roundness": 0.10}
RANGES = {"fwhm": (2.0, 8.0), "eccentricity": (0.3, 0.8), "snr": (50.0, 5.0), "stars": (100.0, 5.0), "roundness": (0.8, 0.3)}
# Upper bounds of the tracking grades in arc seconds.
TRACKING_GRADES = (("A", 0.5), ("B", 1.0), ("C", 2.0), ("D", 5.0))


def steps(c: Column, cuts: list[tuple[float, float]]) -> Column:
    """The value of the first cut that ``c`` is above; 0 below all and for null."""
    out = F.lit(0)
    for bound, value in reversed(cuts):
        out = F.when(c > bound, value).otherwise(out)
    return out


def classify_weather(cloud: Column, rain: Column) -> Column:
    out = F.lit("Overcast")
    for name, bound in reversed(CLOUDS[:-1]):
        out = F.when((cloud >= 0) & (cloud < bound), name).otherwise(out)
    return F.when(rain > 0.1, "Precipitation").when(cloud.isNull(), "Unknown").when(cloud < 0, "Overcast").otherwise(out)


def imaging_score(cloud: Column, wind: Column, humidity: Column, temperature: Column, dewpoint: Column, clear_share: Column | None = None) -> Column:
    """0 to 100 for a night."""
    margin = temperature - dewpoint
    lost = steps(cloud, [(75, 60), (50, 40), (25, 20), (10, 5)]) + steps(wind, [(40, 30), (25, 20), (15, 10)]) + steps(humidity, [(95, 20), (85, 10)])
    lost = lost + F.when(margin < 2, 15).when(margin < 4, 5).otherwise(0)
    score = F.lit(100) - lost
    if clear_share is not None:
        whole = score * (0.5 + 0.5 * clear_share)
        score = F.when(clear_share.isNull(), score).otherwise(F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)))
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def seeing_quality(cloud: Column, wind: Column, humidity: Column, temperature: Column, dewpoint: Column) -> Column:
    margin = temperature - dewpoint
    score = 100 - steps(cloud, [(25, 30), (10, 10)]) - steps(wind, [(30, 40), (20, 25), (10, 10)]) - steps(humidity, [(90, 30), (80, 15)]) - F.when(margin < 2, 25).when(margin < 5, 10).otherwise(0)
    return F.when(cloud > 50, "Poor").when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Poor")


def quality_score(measures: dict[str, Column], weights: dict[str, float] = WEIGHTS, ranges: dict[str, tuple[float, float]] = RANGES) -> Column:
    """Weighted 0 to 100 of measures that count linearly between their best and worst values; an unknown measure counts 0."""
    total = sum(weights.values())
    parts = []
    for name, value in measures.items():
        best, worst = ranges[name]
        linear = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - worst) / (best - worst) * 100))
        parts.append(F.when(value.isNull(), 0.0).otherwise(linear) * (weights[name] / total))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(parts, F.lit(0.0))))


def tracking_grade(rms: Column) -> Column:
    out = F.lit("F")
    for name, bound in reversed(TRACKING_GRADES):
        out = F.when(rms < bound, name).otherwise(out)
    return F.when(rms.isNull(), "-").otherwise(out)


def gnomonic(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Tangent-plane coordinates in degrees; null behind the plane."""
    a, d, a0, d0 = map(F.radians, (ra, dec, ra0, dec0))
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    x = F.when(c > 0, F.degrees(F.cos(d) * F.sin(a - a0) / c))
    y = F.when(c > 0, F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0)) / c))
    return x, y


def tangent(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """As ``gnomonic``, but defined everywhere: behind the plane a position is that of its opposite, and at its edge very far."""
    a, d, a0, d0 = map(F.radians, (ra, dec, ra0, dec0))
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    c = F.when(F.abs(c) < 1e-12, 1e-12).otherwise(c)
    return F.degrees(F.cos(d) * F.sin(a - a0) / c), F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0)) / c)


def image_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arc seconds a pixel."""
    return pixel_um / F.nullif(focal_mm, F.lit(0)) * 206.265


def field_of_view(scale: Column, pixels: Column) -> Column:
    """Degrees."""
    return scale * pixels / 3600


def aitoff_longitude(ra_deg: Column) -> Column:
    """Radians from -pi to pi, growing to the left as on a sky map."""
    return -F.radians(F.when(ra_deg > 180, ra_deg - 360).otherwise(ra_deg))


def dark_hours(dates, column: str, latitude: float, longitude: float, limit: float = -18.0):
    """For each evening of ``dates``: dark_samples, the ten-minute samples from its noon (UTC) to the next with the sun below ``limit`` degrees, and dark_hours.

    The sun's place is that of the low-precision almanac formula, good to a hundredth of a degree.
    """
    samples = dates.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(143))))
    n = F.datediff(F.col(column), F.lit("2000-01-01").cast("date")) + F.col("_k") / 144.0  # days since the noon of 2000-01-01
    mean, anomaly = F.radians(280.460 + 0.9856474 * n), F.radians(357.528 + 0.9856003 * n)
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(F.lit(23.439))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sidereal = F.radians(280.46061837 + 360.98564736629 * n + longitude)
    place = F.radians(F.lit(latitude))
    altitude = F.degrees(F.asin(F.sin(place) * F.sin(declination) + F.cos(place) * F.cos(declination) * F.cos(sidereal - ascension)))
    counted = samples.groupBy(column).agg(F.count(F.when(altitude < limit, 1)).alias("dark_samples"))
    return counted.withColumn("dark_hours", F.round(F.col("dark_samples") / 6.0, 2))


def visibility(ra_deg: Column, dec_deg: Column, latitude: float, longitude: float, date: Column, least: float = 20.0) -> dict[str, Column]:
    """max_altitude, hours_above_min, is_circumpolar, never_rises and transit, rise and set times (HH:MM) of a position in a night."""
    phi, delta = F.radians(F.lit(latitude)), F.radians(dec_deg)
    high = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta)))))
    cosine = (F.sin(F.radians(F.lit(least))) - F.sin(phi) * F.sin(delta)) / (F.cos(phi) * F.cos(delta))
    centuries = (F.datediff(date, F.lit("2000-01-01").cast("date")) - 0.5) / 36525.0
    sidereal = F.pmod(F.pmod(6.697374558 + 2400.0513369 * centuries + 0.0000258622 * centuries * centuries, F.lit(24.0)) + longitude / 15.0, F.lit(24.0))
    always, never = (F.abs(cosine) > 1) & (high > least), (F.abs(cosine) > 1) & (high <= least)
    half = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)) / 15)

    def clock(angle: Column) -> Column:
        hours = F.pmod(F.pmod(ra_deg / 15 + angle, F.lit(24.0)) - sidereal, F.lit(24.0))
        minutes = F.pmod(F.bround(F.when(hours > 18, hours - 24).otherwise(hours) * 60).cast("int"), F.lit(1440))
        return F.when(minutes.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60))

    return {
        "max_altitude": F.round(high, 1), "hours_above_min": F.when(always, 24.0).when(never, 0.0).otherwise(F.round(2 * half, 1)), "is_circumpolar": always, "never_rises": never,
        "transit_time": F.when(~never, clock(F.lit(0.0))), "rise_time": clock(-half), "set_time": clock(half),
    }
