"""Exposure and weather exports as CSV, whatever their headers are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import night_date, normalize_target, parse_timestamp, safe_double, safe_int, target_from_path

# Header spellings by column, without case, spaces, underscores and brackets.
EXPOSURE_HEADERS = {
    "timestamp": ("exposurestart", "exposurestartutc", "date"),
    "target_name": ("targetname", "target", "object"),
    "filter_name": ("filter", "filtername"),
    "exposure_seconds": ("exposuretime", "exposure", "duration"),
    "hfr": ("hfr", "hfrarcsec"),
    "hfr_stdev": ("hfrstdev",),
    "fwhm": ("fwhm", "fwhmarcsec"),
    "eccentricity": ("eccentricity",),
    "detected_stars": ("detectedstars", "stars"),
    "guiding_rms_total": ("guidingrms", "guidingrmsarcsec"),
    "guiding_rms_ra": ("guidingrmsra", "guidingrmsraarcsec"),
    "guiding_rms_dec": ("guidingrmsdec", "guidingrmsdecarcsec"),
    "adu_mean": ("adumean",),
    "adu_median": ("adumedian",),
    "adu_stdev": ("adustdev",),
    "adu_min": ("adumin",),
    "adu_max": ("adumax",),
    "focuser_position": ("focuserposition",),
    "focuser_temp": ("focusertemp", "focusertemperature"),
    "rotator_position": ("rotatorposition",),
    "pier_side": ("pierside",),
    "airmass": ("airmass",),
    "telescope": ("telescope", "telescopename"),
    "camera": ("camera", "cameraname"),
    "sensor_temp": ("sensortemp", "ccdtemp", "temperature"),
    "gain": ("gain",),
    "binning": ("binning",),
    "file_path": ("filepath", "filename"),
}
WEATHER_HEADERS = {
    "timestamp": ("exposurestartutc", "date", "time"),
    "temperature": ("temperature", "ambienttemp"),
    "dewpoint": ("dewpoint",),
    "humidity": ("humidity",),
    "pressure": ("pressure",),
    "wind_speed": ("windspeed",),
    "wind_direction": ("winddirection",),
    "wind_gust": ("windgust",),
    "cloud_cover": ("cloudcover",),
    "sky_quality": ("skyquality", "sqm"),
}
TEXTS = ("target_name", "filter_name", "pier_side", "telescope", "camera", "file_path")
WHOLE = ("detected_stars", "focuser_position", "gain", "binning")


def _squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_()\[\]\x{FEFF}\"]", ""))


def read_aliased_csv(spark: SparkSession, root: str, pattern: str, headers: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of all CSV files below ``root``: a map from column to raw text, with the file's folder and path.

    Each file's own first line names its columns, so files of different layouts are read together; of two headers for one
    column the first counts. Blank lines are skipped, quoted fields may hold commas.
    """
    return aliased_rows(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value"), headers)


def aliased_rows(files: DataFrame, headers: dict[str, tuple[str, ...]]) -> DataFrame:
    """``read_aliased_csv`` of files (source_path, value) that were read whole, of a folder or of a batch of a stream."""
    lines = files.select("source_path", F.split("value", "\r?\n").alias("lines"))
    columns = F.create_map(*(x for name, known in headers.items() for k in known for x in (F.lit(k), F.lit(name))))
    width = lines.agg(F.max(F.size(F.split(F.get("lines", F.lit(0)), ",")))).first()[0] or 1  # of the widest header: one number
    schema = ", ".join(f"c{k} string" for k in range(width))
    fields = lambda c: F.from_csv(c, F.lit(schema), {"mode": "PERMISSIVE", "maxColumns": str(max(20_480, width))})
    parsed = lines.select("source_path", fields(F.get("lines", F.lit(0))).alias("head"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).where("trim(line) <> ''")
    names = F.array(*(columns[_squeezed(F.col("head").getField(f"c{k}"))] for k in range(width)))
    row = parsed.select("source_path", names.alias("names"), fields(F.col("line")).alias("row"))
    values = F.array(*(F.col("row").getField(f"c{k}") for k in range(width)))
    pairs = F.filter(F.arrays_zip(F.col("names").alias("name"), values.alias("value")), lambda p: p["name"].isNotNull())
    first = lambda name: F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"]
    return row.select("source_path", F.regexp_replace("source_path", r"/[^/]*$", "").alias("folder"), *(F.trim(first(name)).alias(name) for name in headers))


def read_exposure_csv(spark: SparkSession, root: str, pattern: str = "*ImageMetaData*.csv") -> DataFrame:
    """Typed exposures; rows without a readable timestamp are left out. A missing target is taken from the path."""
    return typed_exposures(read_aliased_csv(spark, root, pattern, EXPOSURE_HEADERS))


def typed_exposures(raw: DataFrame) -> DataFrame:
    typed = {c: safe_int(F.col(c)) if c in WHOLE else safe_double(F.col(c)) for c in EXPOSURE_HEADERS if c not in TEXTS and c != "timestamp"}
    named = F.coalesce(F.nullif(F.col("target_name"), F.lit("")), target_from_path(F.col("source_path")), target_from_path(F.col("file_path")))
    rows = raw.withColumns(typed | {"timestamp": parse_timestamp(F.col("timestamp")), "target_name": normalize_target(named)})
    return rows.where("timestamp is not null").withColumn("session_date", night_date(F.col("timestamp")))


def read_weather_csv(spark: SparkSession, root: str, pattern: str = "*WeatherData*.csv") -> DataFrame:
    return typed_weather(read_aliased_csv(spark, root, pattern, WEATHER_HEADERS))


def typed_weather(raw: DataFrame) -> DataFrame:
    typed = {c: safe_double(F.col(c)) for c in WEATHER_HEADERS if c != "timestamp"}
    return raw.withColumns(typed | {"timestamp": parse_timestamp(F.col("timestamp"))}).where("timestamp is not null")


def scan_sessions(spark: SparkSession, root: str, tolerance: float = 30.0) -> DataFrame:
    """Exposures with the weather of the same folder that is nearest within ``tolerance`` seconds."""
    from ..operators.joins import nearest_join

    exposures = read_exposure_csv(spark, root).withColumn("_row", F.xxhash64("source_path", "timestamp", "file_path"))
    weather = read_weather_csv(spark, root).withColumn("_row", F.xxhash64("source_path", "timestamp"))
    kept = ["temperature", "dewpoint", "humidity", "pressure", "wind_speed", "cloud_cover", "sky_quality"]
    return nearest_join(exposures, weather.select("folder", "timestamp", "_row", *kept), "timestamp", ["folder"], kept, tolerance, "_row", "_row").drop("_row")
