"""Listings, searches, file plans and storage estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..plans.durable import stored
from .selection import numbered

# Image file endings, and folders of processed and of calibration files that a listing may skip.
IMAGE_ENDS = (".fits", ".fit", ".fts", ".xisf", ".fits.fz")
CALIBRATION_FOLDERS = ("dark", "darks", "flat", "flats", "bias", "biases", "offset", "darkflat", "darkflats", "calibration", "masters")
PATTERN = "$$IMAGETYPE$$_$$TARGETNAME$$_$$DATETIME$$_$$FILTER$$_$$BINNING$$_$$EXPOSURETIME$$s_$$ROTATORANGLE$$deg_$$SENSORTEMP$$_$$TELESCOPE$$_$$CAMERA$$_$$FRAMENR$$"
DEFAULT_FOLDERS = {"DARK": "{CAMERA}/{IMAGETYP}/{EXPTIME}_{TEMP}", "BIAS": "{CAMERA}/{IMAGETYP}/{EXPTIME}_{TEMP}"}
MOST_PATH = 250  # characters of a destination that every file system takes


def exposures_where(exposures: DataFrame, **wanted) -> DataFrame:
    """Rows with every wanted value that is not None, ordered by session date and time; the values are pushed to the scan."""
    for column, value in wanted.items():
        if value is not None:
            exposures = exposures.where(F.col(column) == value)
    return exposures.orderBy("session_date", "timestamp")


def listing(table: DataFrame, where: dict, order: list) -> DataFrame:
    """A point lookup or listing: equal values, in order (names, or columns with a direction)."""
    for column, value in where.items():
        table = table.where(F.col(column) == value)
    return table.orderBy(*order)


def search_dimension(table: DataFrame, text: str, columns: list[str], equal: dict | None = None, ranges: dict | None = None, order: list[str] | None = None, most: int = 500) -> DataFrame:
    """The first ``most`` rows, in order, that hold ``text`` in one of ``columns`` (whatever the case), with equal values and low <= value < high."""
    found = table.where(naming.any_of([F.lower(c).contains(text.lower()) for c in columns])) if text else table
    for column, value in (equal or {}).items():
        found = found.where(F.col(column) == value)
    for column, (low, high) in (ranges or {}).items():
        found = found.where((F.col(column) >= low) & (F.col(column) < high))
    return found.orderBy(*(order or columns)).limit(most)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of tables that share some columns; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def filename_tokens() -> dict[str, Column]:
    """The parts of a file name from frame columns."""
    named = lambda c: F.coalesce(F.nullif(naming.sanitize(F.col(c)), F.lit("")), F.lit("Unknown"))
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    when = F.col("date_obs").cast("timestamp")
    return {
        "$$IMAGETYPE$$": F.coalesce("image_type", F.lit("UNKNOWN")), "$$TARGETNAME$$": named("target"), "$$DATETIME$$": F.coalesce(F.date_format(when, "yyyy-MM-dd_HH-mm-ss"), F.lit("0000-00-00_00-00-00")),
        "$$DATE$$": F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("0000-00-00")), "$$TIME$$": F.coalesce(F.date_format(when, "HH-mm-ss"), F.lit("00-00-00")), "$$FILTER$$": naming.sanitize(F.col("filter")),
        "$$BINNING$$": F.concat_ws("x", F.coalesce("binning", F.lit(1)), F.coalesce("binning", F.lit(1))), "$$EXPOSURETIME$$": two("exposure"), "$$ROTATORANGLE$$": two("rotation"),
        "$$SENSORTEMP$$": F.coalesce(F.bround("temperature").cast("int"), F.lit(0)), "$$TELESCOPE$$": named("telescope"), "$$CAMERA$$": named("camera"), "$$GAIN$$": F.coalesce(F.col("gain").cast("int"), F.lit(0)),
    }


FRAME_GROUP = ("target", "filter", "telescope", "image_type")


def rename_plan(frames: DataFrame, extension: str, pattern: str = PATTERN) -> DataFrame:
    """path and name: frames are numbered inside target, filter, telescope and image type by time, then path; names that collide get a suffix."""
    named = numbered(frames, list(FRAME_GROUP), ["date_obs", "path"], "_number").withColumn("_name", naming.build_filename(pattern, filename_tokens(), F.col("_number"), extension))
    return conflict_free(stored(named.select("path", "_name")), "_name", ["path"], "name").select("path", "name")  # read twice, for the ranges and their rows


def conflict_free(rows: DataFrame, path: str, by: list[str], out: str) -> DataFrame:
    """Adds ``out``: of rows with one path the first keeps it, later ones get _2, _3 ... before the extension, in the order of ``by``."""
    numbers = numbered(rows, [path], by, "_k")
    marked = F.concat(F.regexp_extract(path, r"^(.*?)(\.[A-Za-z]+)?$", 1), F.lit("_"), "_k", F.regexp_extract(path, r"^(.*?)(\.[A-Za-z]+)?$", 2))
    return numbers.select(*rows.columns, F.when(F.col("_k") > 1, marked).otherwise(F.col(path)).alias(out))


def folder_of(template: str | None = None) -> Column:
    """The folder of a frame: ``template``, or by image type darks and biases under their camera and other frames under their target."""
    whole = F.col("exposure") == F.floor("exposure")
    tokens = {
        "{OBJECT}": F.col("target"), "{IMAGETYP}": F.col("image_type"), "{FILTER}": F.col("filter"), "{DATE}": F.coalesce(F.date_format(F.col("date_obs").cast("timestamp"), "yyyy-MM-dd"), F.lit("Unknown_Date")), "{CAMERA}": F.col("camera"), "{TELESCOPE}": F.col("telescope"),
        "{EXPTIME}": F.when(whole, F.col("exposure").cast("long").cast("string")).otherwise(F.format_string("%.1f", "exposure")), "{TEMP}": F.bround("temperature").cast("int"), "{GAIN}": F.col("gain"), "{BINNING}": F.col("binning"),
    }
    if template:
        return naming.expand_template(template, tokens)
    out = None
    for kind, own in DEFAULT_FOLDERS.items():
        out = (F.when if out is None else out.when)(F.col("image_type") == kind, naming.expand_template(own, tokens))
    return out.otherwise(naming.expand_template("{OBJECT}/{IMAGETYP}/{FILTER}", tokens))


def build_plan(frames: DataFrame, root: str, name: str, template: str | None = None) -> DataFrame:
    """path, destination and status (ok, unsafe, too_long) of an export: folder and file ``name``, a suffix where two would share a destination.

    A destination is unsafe if a part of it is '..'. Nothing is copied.
    """
    placed = frames.withColumn("_to", F.concat_ws("/", F.lit(root), folder_of(template), F.col(name).cast("string")))
    out = conflict_free(placed, "_to", ["path"], "destination")
    unsafe = F.array_contains(F.split("destination", "/"), "..")
    return out.select("path", "image_type", "destination", F.when(unsafe, "unsafe").when(F.length("destination") > MOST_PATH, "too_long").otherwise("ok").alias("status"))


def plan_statistics(plan: DataFrame) -> DataFrame:
    return plan.groupBy("image_type", "status").agg(F.count("*").alias("n_files"), F.countDistinct(F.regexp_extract("destination", "^(.*)/", 1)).alias("n_folders"))


def folder_tree(plan: DataFrame) -> DataFrame:
    """folder, depth and n_files of every folder above a destination, counted after one row for each folder that holds files."""
    direct = plan.groupBy(F.regexp_extract("destination", "^(.*)/", 1).alias("folder")).agg(F.count("*").alias("n"))
    parts = F.split("folder", "/")
    above = direct.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("up", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    return above.groupBy(F.col("up").alias("folder"), "depth").agg(F.sum("n").alias("n_files"))


def storage_savings(files: DataFrame, now: str, days: int = 180) -> DataFrame:
    """kind, n, size and savings: FITS that compressing would halve, XISF that recompressing would cut by 15 %, calibration files older than ``days``."""
    date, size = F.lit(now).cast("date"), F.col("length")
    kinds = {"compress": (F.col("path").endswith(".fits"), 0.5), "recompress": (F.col("path").endswith(".xisf"), 0.15), "archive": (F.col("is_calibration") & (F.col("modified") < F.date_sub(date, days)), None)}
    parts = []
    for kind, (test, share) in kinds.items():
        parts += [F.count(F.when(test, 1)).alias(f"{kind}_n"), F.sum(F.when(test, size)).cast("long").alias(f"{kind}_size")]
    one = files.agg(*parts)
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_size").alias("size"), (F.floor(F.col(f"{k}_size") * share) if share else F.lit(None)).cast("long").alias("savings")) for k, (_, share) in kinds.items()))
    return one.select(F.inline(rows))


def list_image_files(spark: SparkSession, root: str, skip_calibration: bool = False, skip_processed: bool = True) -> DataFrame:
    """path, length and modified of the image files under ``root``; contents are not read. Processed and calibration files can be left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return select_image_files(found, skip_calibration, skip_processed)


def select_image_files(files: DataFrame, skip_calibration: bool = False, skip_processed: bool = True) -> DataFrame:
    """The rules of ``list_image_files`` on a table with path."""
    found = files.where(naming.any_of([F.lower("path").endswith(e) for e in IMAGE_ENDS]))
    if skip_processed:
        found = found.where(~naming.is_processed_path(F.col("path")))
    if skip_calibration:
        parts = F.split(F.lower("path"), "/")
        found = found.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, CALIBRATION_FOLDERS))))
    return found
