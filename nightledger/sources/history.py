"""Observation histories as JSON and CSV, frame reports, catalogue dimensions and forum exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of an observation CSV, with the types of the numbers.
COLUMNS = ("target_name", "canonical_name", "object_type", "ra", "dec", "observation_date", "filter", "exposure_time", "frame_count", "setup", "telescope", "camera", "hfr", "fwhm", "temperature", "notes")
NUMBERS = {"ra": "double", "dec": "double", "exposure_time": "double", "frame_count": "int", "hfr": "double", "fwhm": "double", "temperature": "double"}
OBSERVED = "observation_date string, filter string, exposure_time double, frame_count int, setup string, telescope string, camera string, hfr double, fwhm double, temperature double, notes string"
HISTORY = f"version string, targets array<struct<name: string, canonical_name: string, ra: double, dec: double, object_type: string, observations: array<struct<{', '.join(c.replace(' ', ': ') for c in OBSERVED.split(', '))}>>>>"


def read_observations_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason). Rows without a target are skipped; one whose number can't be read is rejected. Columns are found by the
    header, and may lack or come in any order."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in raw.columns else F.lit(None).cast("string") for c in COLUMNS}
    rows = raw.select(*(v.alias(c) for c, v in have.items())).where("target_name is not null")
    bad = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.lit(f"invalid {c}")) for c in NUMBERS)), lambda x: x.isNotNull()), ", ")
    judged = rows.withColumn("reason", bad)
    good = judged.where("reason = ''").select(*(F.col(c).try_cast("double").cast(NUMBERS[c]).alias(c) if c in NUMBERS else F.col(c) for c in COLUMNS))
    return good, judged.where("reason <> ''")


def read_history_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(targets, observations with target_name) of history files; a target without observations is a target still, and a repeated one counts once."""
    parts = spark.read.schema(HISTORY).json(path, multiLine=True).select(F.explode("targets").alias("t"))
    targets = parts.select("t.name", "t.canonical_name", "t.ra", "t.dec", "t.object_type").where("name <> ''").dropDuplicates(["name"])
    return targets, parts.select(F.col("t.name").alias("target_name"), F.explode("t.observations").alias("o")).select("target_name", "o.*")


def nested_history(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """Targets (id, name, ...) with their observations (target_id, ...) as an array in order of date; ids are left out. A target's list is as long as its observations."""
    columns = [c for c in observations.columns if c not in ("id", "target_id")]
    first = ["observation_date", *(c for c in columns if c != "observation_date")]
    lists = observations.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("observations"))
    return targets.join(lists, F.col("id") == F.col("target_id"), "left").drop("id", "target_id")


def write_history_json(targets: DataFrame, observations: DataFrame, path: str) -> None:
    nested_history(targets, observations).write.mode("overwrite").json(path)


def history_rows(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """The rows of an observation CSV, the latest date first, then by target."""
    own = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), *(c for c in ("canonical_name", "object_type", "ra", "dec") if c in targets.columns))
    joined = observations.join(own, "target_id")
    return joined.select(*(c for c in COLUMNS if c in joined.columns)).orderBy(F.desc("observation_date"), "target_name")


def write_observations_csv(targets: DataFrame, observations: DataFrame, path: str) -> None:
    history_rows(targets, observations).write.mode("overwrite").csv(path, header=True, escape='"')


def quality_report(frames: DataFrame, with_rejected: bool = False) -> DataFrame:
    """Frames for a report, the best score first; rejected ones only on demand."""
    return (frames if with_rejected else frames.where("not rejected")).orderBy(F.desc_nulls_last("score"), "path")


def accepted_list(frames: DataFrame) -> DataFrame:
    return frames.where("not rejected").select(F.col("path").alias("value")).orderBy("value")


def load_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A catalogue (Parquet or CSV with a header) with one row for each ``key``, the first by its other columns; small enough to be joined as it is."""
    table = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    others = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*") if others else table.distinct()


def export_filter_ids(details: DataFrame, ids: DataFrame) -> DataFrame:
    """date, filter (the forum's number), number and duration of acquisitions (night, filter, exposure, n); filters without a number have none."""
    return details.join(ids, F.col("filter") == F.col("filter_name"), "left").groupBy(F.col("night").alias("date"), F.col("filter_id").alias("filter"), F.col("exposure").alias("duration")).agg(F.sum("n").alias("number"))
