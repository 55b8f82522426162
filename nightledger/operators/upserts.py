"""Keyed maintenance of tables as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``base`` with the rows of ``new`` whose key it lacks, the first by ``tie`` of each key.

    A null in a key makes it distinct from any other, so such rows always come in.
    """
    whole = " and ".join(f"`{k}` is not null" for k in keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(tie))
    fresh = new.where(whole).withColumn("_r", first).where("_r = 1").drop("_r").join(base.select(*keys), keys, "left_anti").select(*base.columns)
    return base.unionByName(fresh).unionByName(new.where(f"not ({whole})").select(*base.columns))


def upsert_replace(base: DataFrame, new: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those of equal keys; null and '' are equal. The last by ``tie`` wins."""
    blank: dict[str, Column] = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    keyed = new.withColumns(blank)
    last = F.row_number().over(Window.partitionBy(*blank).orderBy(F.desc(tie)))
    latest = keyed.withColumn("_r", last).where("_r = 1").drop("_r")
    kept = base.withColumns(blank).join(latest.select(*blank), list(blank), "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def upsert_targets(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join by ``key``: values of ``new`` where they aren't null, else those of ``base``."""
    right = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    joined = base.join(right, F.col(key) == F.col(f"_{key}"), "full")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in base.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: str, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents where ``gone`` holds and without their children."""
    dropped = parents.where(gone).select(F.col(key).alias(foreign))
    return parents.where(f"not coalesce({gone}, false)"), children.join(dropped, foreign, "left_anti")


def merge_targets(observations: DataFrame, source: int, into: int) -> DataFrame:
    return observations.withColumn("target_id", F.when(F.col("target_id") == source, into).otherwise(F.col("target_id")))


def fill_object_types(targets: DataFrame, types: DataFrame) -> DataFrame:
    """Missing object types by name, else by canonical name, from ``types`` (name, object_type)."""
    types = types.groupBy("name").agg(F.min("object_type").alias("object_type"))  # a repeated name multiplies nothing
    by_name = types.select(F.col("name"), F.col("object_type").alias("_a"))
    by_canonical = types.select(F.col("name").alias("canonical_name"), F.col("object_type").alias("_b"))
    filled = targets.join(by_name, "name", "left").join(by_canonical, "canonical_name", "left")
    return filled.select(*(F.coalesce("object_type", "_a", "_b").alias(c) if c == "object_type" else F.col(c) for c in targets.columns))


def upsert_canonical(base: DataFrame, new: DataFrame) -> DataFrame:
    """``upsert_targets`` by name as the catalogue does it: a canonical name loses a leading 'NAME ', and a new row whose canonical name a row of ``base`` has is
    merged into that row (the one of the smallest id), so it brings no row of its own. Of several new rows of one row the last by id wins for each value."""
    tidy = F.regexp_replace(F.trim("canonical_name"), "(?i)^NAME +", "")
    new = new.withColumn("canonical_name", F.nullif(tidy, F.lit("")))
    by_name = base.groupBy("name").agg(F.min("id").alias("_by_name"))
    by_canonical = base.where("canonical_name <> ''").groupBy("canonical_name").agg(F.min("id").alias("_by_canonical"))
    met = new.join(by_canonical, "canonical_name", "left").join(by_name, "name", "left").withColumn("_into", F.coalesce("_by_canonical", "_by_name"))
    values = [c for c in base.columns if c not in ("id", "name")]
    merged = met.where("_into is not null").groupBy("_into").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}") for c in values))
    kept = base.join(merged, F.col("id") == F.col("_into"), "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns))
    fresh = met.where("_into is null").groupBy("name").agg(F.max(F.struct("id", *values)).alias("_r")).select(*(F.col("name") if c == "name" else F.col(f"_r.{c}").alias(c) for c in base.columns))
    return kept.unionByName(fresh)


def delete_older(table: DataFrame, time: str, now: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``; rows without a time stay."""
    return table.where(F.col(time).isNull() | (F.col(time) >= F.date_sub(F.lit(now).cast("date"), days)))


def store_analysis(observations: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """``observations`` with the sums of ``details`` (n frames of an exposure) in place of the rows of equal keys; null and '' are equal."""
    sums = details.groupBy(*keys).agg(F.sum(F.col("n") * F.col("exposure")).alias("exposure_time"), F.sum("n").alias("frame_count")).withColumn("seq", F.lit(0).cast("long"))
    return upsert_replace(observations, sums.select(*observations.columns), keys, "seq")


def assign_tags(links: DataFrame, targets: DataFrame, tag_id: int) -> DataFrame:
    """``links`` (target_id, tag_id) with the tag for each of ``targets`` (id) that lacks it."""
    new = targets.select(F.col("id").alias("target_id"), F.lit(tag_id).alias("tag_id")).distinct()
    return links.unionByName(new.join(links, ["target_id", "tag_id"], "left_anti"))


STAGES = ("planned", "acquiring", "processing", "done")


def set_stage(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """``targets`` with the stage of ``changes`` (id, stage; the last of an id by name) where it is one of STAGES; other changes have no effect."""
    valid = changes.where(F.col("stage").isin(*STAGES)).groupBy("id").agg(F.max("stage").alias("_stage"))
    return targets.join(valid, "id", "left").withColumn("stage", F.coalesce("_stage", "stage")).drop("_stage").select(*targets.columns)


def upsert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes by session date and target, '' and null targets being equal; the last by row wins."""
    return upsert_replace(notes, new, ["session_date", "target_name"], "row")
