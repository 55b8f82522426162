"""Incremental imports into tables kept by key, and summaries of nights that follow them.

A batch of a stream is merged into its table by key, in the nights it touches (see ``operators.merge``), so a row comes in once however late and however often it comes, and
no state but the table is kept. Rows carry the batch that brought them: a batch that runs again after a failure takes its own rows out first, so those with a null in their key, which are distinct from
any other, don't come twice either. A ledger beside the table's parts says which batches are through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import night_date
from ..operators import stats, upserts
from ..operators.merge import merge, replace_rows, table_rows
from ..sources.exposures import EXPOSURE_HEADERS, WEATHER_HEADERS, aliased_rows, typed_exposures, typed_weather

BATCH = "import_batch"
EXPOSURE_KEY, WEATHER_KEY = ("timestamp", "file_path"), ("timestamp", "folder")


def stream_exposures(spark: SparkSession, folder: str, schema: StructType, late: str = "36 hours") -> DataFrame:
    """New Parquet files of exposures, each (timestamp, file_path) once while its night is within ``late``. For ever: ``import_exposures``."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["timestamp", "file_path"])


def stream_weather(spark: SparkSession, folder: str, schema: StructType, late: str = "36 hours") -> DataFrame:
    """New Parquet files of weather readings, each (timestamp, telescope) once while its night is within ``late``. For ever: ``import_weather``."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["timestamp", "telescope"])


def stream_session_summary(exposures: DataFrame, late: str = "36 hours") -> DataFrame:
    """Counts by night (noon to noon), in append mode once the watermark has passed."""
    watermarked = exposures if exposures.isStreaming else exposures.withWatermark("timestamp", late)
    night = F.window("timestamp", "1 day", "1 day", "12 hours")
    return watermarked.groupBy(night.alias("night")).agg(F.count("*").alias("n_exposures"), F.sum("exposure_seconds").alias("total_seconds")).select(F.to_date("night.start").alias("session_date"), "n_exposures", "total_seconds")


def night() -> Column:
    return night_date(F.col("timestamp"))


def _ledger(folder: str) -> str:
    return f"{folder}/_ledger"


def is_through(spark: SparkSession, folder: str, batch: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(_ledger(folder))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    return not spark.read.schema("batch string").parquet(_ledger(folder)).where(F.col("batch") == batch).isEmpty()


def import_rows(folder: str, new: DataFrame, batch: str, keys: list[str], tie: str, part: Column) -> list[str]:
    """Merges one batch into the table by ``keys`` (of several new rows of a key the first by ``tie``); gives the parts that changed. The same batch again changes nothing."""

    def how(base: DataFrame, rows: DataFrame) -> DataFrame:
        return upserts.insert_ignore(base.where(F.col(BATCH) != batch), rows, keys, tie)

    return merge(folder, new.withColumn(BATCH, F.lit(batch)), part, how)


def start_import(stream: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, name: str, keys: list[str], tie: str, part: Column, then: Callable[[DataFrame, list[str]], None] | None = None) -> StreamingQuery:
    """Runs all that ``stream`` has now through ``read`` into the table, batch by batch; ``then`` gets a batch's rows and its parts once it is merged."""

    def each(rows: DataFrame, number: int) -> None:
        spark, batch = rows.sparkSession, f"{name}-{number}"
        if is_through(spark, folder, batch):
            return
        new = read(rows)
        import_rows(folder, new, batch, keys, tie, part)
        if then:
            then(new, sorted(r[0] for r in new.select(part.cast("string")).distinct().collect()))  # nights of a batch
        spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(_ledger(folder))

    return stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, root: str, pattern: str, most: int = 1000) -> DataFrame:
    """(source_path, value) of new files below ``root``, whole, at most ``most`` in a batch."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most)
    return files.load(root).select(F.col("_metadata.file_path").alias("source_path"), "value")


def import_exposures(spark: SparkSession, root: str, folder: str, checkpoint: str, summaries: str | None = None, name: str = "exposures", pattern: str = "*ImageMetaData*.csv", most: int = 1000) -> StreamingQuery:
    """New exposure exports below ``root``, of any header spelling, into the table in ``folder``: one row for each (timestamp, file_path), for ever. With ``summaries``
    the nights that a batch touches are summed up anew there (``session_summary``)."""
    read = lambda files: typed_exposures(aliased_rows(files, EXPOSURE_HEADERS))
    then = (lambda new, nights: summarise(table_rows(spark, folder, new.withColumn(BATCH, F.lit("")).schema, nights), summaries)) if summaries else None
    return start_import(stream_files(spark, root, pattern, most), read, folder, checkpoint, name, list(EXPOSURE_KEY), "source_path", night(), then)


def import_weather(spark: SparkSession, root: str, folder: str, checkpoint: str, name: str = "weather", pattern: str = "*WeatherData*.csv", most: int = 1000) -> StreamingQuery:
    """New weather exports below ``root`` into the table in ``folder``: one row for each (timestamp, folder of the export), for ever."""
    read = lambda files: typed_weather(aliased_rows(files, WEATHER_HEADERS))
    return start_import(stream_files(spark, root, pattern, most), read, folder, checkpoint, name, list(WEATHER_KEY), "source_path", night())


def summarise(nights: DataFrame, summaries: str) -> list[str]:
    """Puts the summaries of whole nights in place of those in the table ``summaries``."""
    found = stats.session_summary(nights)
    return replace_rows(summaries, found, ["session_date"], "n_exposures", F.date_format("session_date", "yyyy-MM"))


def running_summary(spark: SparkSession, summaries: str, like: StructType) -> DataFrame:
    """The summaries of all nights so far."""
    return table_rows(spark, summaries, like).drop("part")


def stream_night_summary(exposures: DataFrame, late: str = "36 hours") -> DataFrame:
    """Summaries by night (noon to noon) as a stream, in append mode once the watermark has passed a night, for streams whose rows come once.

    Two stateful operators, one after the other: sums by night and distinct target, filter and telescope, then a night's sums of those. State holds a night's distinct names, not its rows.
    """
    rows = exposures.withWatermark("timestamp", late)
    night = F.window("timestamp", "1 day", "1 day", "12 hours")
    sums = [F.sum("exposure_seconds").alias("seconds"), *(x for c in ("hfr", "fwhm") for x in (F.sum(c).alias(c), F.count(c).alias(f"n_{c}"))), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")]
    each = rows.groupBy(night.alias("night"), "target_name", "filter_name", "telescope").agg(F.count("*").alias("n"), *sums)
    mean = lambda c: (F.sum(c) / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"avg_{c}")
    whole = each.groupBy(F.window("night", "1 day", "1 day", "12 hours").alias("night")).agg(
        F.sum("n").alias("n_exposures"), F.size(F.collect_set("target_name")).cast("long").alias("n_targets"), F.sum("seconds").alias("total_seconds"), mean("hfr"), mean("fwhm"), *(stats.names(c).alias(n) for c, n in (("target_name", "targets"), ("filter_name", "filters"), ("telescope", "telescopes"))),
        F.min("first").alias("first_exposure"), F.max("last").alias("last_exposure"),
    )
    return whole.select(F.to_date("night.start").alias("session_date"), *(c for c in whole.columns if c != "night"))
