"""Corpus cleaning in five stages, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows may repeat a doc_id or lack one; null texts count as empty.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.llm import blocks, lines, nearcopies, pieces, quality, sources
from nightledger.plans.durable import stored

#: Near copies: the least Jaccard similarity of distinct five-word shingles.
SIMILAR = Fraction(4, 5)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; the others go."""
    found = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return blocks.restored(found.where("predicted = 1"), docs)


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier line; n_chars follows. No document goes."""
    found = blocks.restored(lines.dedup_lines(docs, carry=True), docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id; of rows with one doc_id and text, one.

    Candidates are the groups that op5's SimHash links, and texts that share a key of minimum hashes. A group is connected by candidates whose distinct five-word
    shingles are as similar as SIMILAR; texts without words are copies of one another. Rows without a doc_id are known by their text's hash. Rows that share a doc_id but not the
    text go together: all stay if one of them stands for its group.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.coalesce("doc_id", text).alias("key"), text.alias("copy"), F.struct("*").alias("row"))  # no column of docs can clash
    found = nearcopies.least_ids(rows.select("key", F.col("row.text").alias("text")), "key", "text", SIMILAR)
    stay = found.select(F.col("component_id").alias("key")).distinct()
    one = Window.partitionBy("key", "copy").orderBy(F.xxhash64("row"))  # rows of one id and text that differ elsewhere: the smallest hash
    kept = rows.join(stay, "key", "left_semi").withColumn("place", F.row_number().over(one))
    return kept.where("place = 1").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken by its size, rounded (0, 1 or 2).

    Rows of one doc_id and size share what is taken of them evenly. Documents without words stay once.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(sources.WORD)), F.lit(0)).cast("long")
    taken = sources.mix_sources(docs.select("doc_id", "text", "source")).groupBy("doc_id", "size").agg(F.avg("taken").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("id"), F.col("size").alias("words"), "taken")
    rows = docs.select(size.alias("own_words"), F.struct("*").alias("row"))  # no column of docs can clash
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_words") == F.col("words"))
    times = F.when(F.col("words") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("words") + 0.5)).cast("int")
    joined = rows.join(taken, same).withColumn("time", F.explode(F.sequence(F.lit(0), times))).where("time > 0")
    return joined.select("row.*")


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 and round_trip of every document."""
    return pieces.digest(docs)


STAGES = [("quality", keep_good), ("lines", drop_similar_lines), ("near copies", drop_near_copies), ("mix", mix), ("ids", to_ids)]
ORACLE_SQL = None  # compression, shingle hashes and piece vocabularies have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
