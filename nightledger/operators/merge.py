"""Tables in folders, kept by key: a merge reads and writes only the parts that new rows touch.

A table is a folder of Parquet partitioned by ``part``, a text made of the key (its hash's bucket, or a night that the key gives), so equal keys share a part. New rows are merged into
those parts with the operators of ``upserts``, written aside, and put in place by dynamic partition overwrite; a part whose rows come out as they were is not written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.durable import stored
from . import upserts

BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket(keys: list[str], count: int = BUCKETS) -> Column:
    """The part of a key by its hash; null and '' are one, as for ``upsert_replace``."""
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), F.lit(count)).cast("string")


def table_rows(spark: SparkSession, folder: str, schema: StructType, parts: list[str] | None = None) -> DataFrame:
    """The table's rows, of some parts if they are named; none where nothing was written yet."""
    whole = StructType([*schema.fields]).add("part", "string")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(folder)
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def _sums(rows: DataFrame, name: str) -> DataFrame:
    columns = [c for c in rows.columns if c != "part"]
    return rows.groupBy("part").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("a"), F.sum(F.xxhash64(F.lit(1), *columns) % 1_000_003).alias("b")).alias(name))


def merge(folder: str, new: DataFrame, part: Column, how: Merge, schema: StructType | None = None) -> list[str]:
    """Merges ``new`` into the table by ``how`` (touched rows of the table, new rows -> rows); gives the parts that changed.

    ``part`` is an expression over the rows that equal keys share. Only part names are collected. A part that comes out empty keeps no rows.
    """
    spark = new.sparkSession
    schema = schema or new.schema
    fresh = stored(new.withColumn("part", part.cast("string")))
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())
    if not touched:
        return []
    base = table_rows(spark, folder, schema, touched)
    merged = how(base.drop("part"), fresh.drop("part")).select(*schema.names).withColumn("part", part.cast("string"))
    after = stored(merged)
    sums = _sums(base, "before").join(_sums(after, "now"), "part", "full")
    moved = sums.where(~F.col("before").eqNullSafe(F.col("now"))).select("part", F.col("now").isNull().alias("empty")).collect()  # a row for each touched part at most
    changed = sorted(r["part"] for r in moved if not r["empty"])
    if changed:
        after.where(F.col("part").isin(changed)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    for gone in (r["part"] for r in moved if r["empty"]):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part={gone}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return sorted(r["part"] for r in moved)


def insert_new(folder: str, new: DataFrame, keys: list[str], tie: str, part: Column | None = None) -> list[str]:
    """Rows of ``new`` whose key the table lacks; a null in a key makes it distinct from any other. See ``upserts.insert_ignore``."""
    return merge(folder, new, bucket(keys) if part is None else part, lambda base, rows: upserts.insert_ignore(base, rows, keys, tie))


def replace_rows(folder: str, new: DataFrame, keys: list[str], tie: str, part: Column | None = None) -> list[str]:
    """Rows of ``new`` in place of those of equal keys, null and '' being equal; the last by ``tie`` wins. See ``upserts.upsert_replace``."""
    return merge(folder, new, bucket(keys) if part is None else part, lambda base, rows: upserts.upsert_replace(base, rows, keys, tie))


def update_values(folder: str, new: DataFrame, key: str, part: Column | None = None) -> list[str]:
    """Values of ``new`` where they aren't null, else the table's. See ``upserts.upsert_targets``."""
    return merge(folder, new, bucket([key]) if part is None else part, lambda base, rows: upserts.upsert_targets(base, rows, key))


def delete_keys(folder: str, gone: DataFrame, keys: list[str], schema: StructType, part: Column | None = None) -> list[str]:
    """The table without the rows whose keys (null like null) are in ``gone``."""

    def without(base: DataFrame, rows: DataFrame) -> DataFrame:
        other = rows.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return base.join(other, same, "left_anti")

    return merge(folder, gone.select(*keys), bucket(keys) if part is None else part, without, schema)
