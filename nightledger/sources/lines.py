"""Numbered lines of text files that Spark splits, and states that run along the lines of a file over many tasks.

A log of any length is read by as many tasks as it has splits. What a parser carries from line to line (the open section, its
number, its first line) goes over two levels: along the lines of a piece of ``PIECE`` lines, and along the pieces of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import stored

PIECE = 65_536  # lines of a file that one task takes together
FILE = "source_path"


def text_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(source_path, line_no, line) of the text files below ``root`` whose names fit ``pattern``; numbers are long, from 0 in each file.

    Lines end with LF or CRLF; a file without a byte has none. Files are split as ``spark.sql.files.maxPartitionBytes`` says. Splits are counted, and a
    line's number is the lines of the splits before it and its place in its own. Lines are written to the checkpoint folder first, so that counts and
    places are of the same splits whenever a task runs again.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    split = read.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))
    kept = stored(split)
    counts = kept.groupBy(FILE, "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(FILE).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    offsets = counts.select(FILE, "start", (before - F.col("first")).alias("offset"))
    return kept.join(offsets, [FILE, "start"]).select(FILE, (F.col("place") + F.col("offset")).alias("line_no"), "line")


def _piece(size: int) -> Column:
    return F.floor(F.col("line_no") / size).cast("long")


def following(lines: DataFrame, asked: dict[str, int], size: int | None = None) -> DataFrame:
    """``lines`` with new columns: name -> the line so many lines further on in the file, null after its end. The first lines of a piece are also sent to the piece before."""
    size, reach = size or PIECE, max(asked.values())
    early = F.when((F.col("line_no") % size < reach) & (F.col("line_no") >= size), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = lines.withColumn("_back", F.explode(early)).withColumn("_piece", _piece(size) - F.col("_back"))
    order = Window.partitionBy(FILE, "_piece").orderBy("line_no")
    return sent.withColumns({name: F.lead("line", k).over(order) for name, k in asked.items()}).where("_back = 0").drop("_back", "_piece")


def running(lines: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, size: int | None = None) -> DataFrame:
    """``lines`` with running values up to and with each line of its file: ``sums`` (name -> whole number or condition) and ``lasts`` (name -> a value; its last that is not null)."""
    sums, lasts = {k: v.cast("long") for k, v in (sums or {}).items()}, lasts or {}
    marked = lines.withColumns({"_piece": _piece(size or PIECE)} | {f"_at_{k}": v for k, v in (sums | lasts).items()})
    upto = Window.partitionBy(FILE, "_piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = marked.groupBy(FILE, "_piece").agg(
        *(F.sum(f"_at_{k}").alias(f"_of_{k}") for k in sums),
        *(F.max_by(f"_at_{k}", F.when(F.col(f"_at_{k}").isNotNull(), F.col("line_no"))).alias(f"_of_{k}") for k in lasts),
    )
    earlier = Window.partitionBy(FILE).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    states = ends.select(FILE, "_piece", *(F.sum(f"_of_{k}").over(earlier).alias(f"_in_{k}") for k in sums), *(F.last(f"_of_{k}", ignorenulls=True).over(earlier).alias(f"_in_{k}") for k in lasts))
    values = {k: F.coalesce(F.sum(f"_at_{k}").over(upto), F.lit(0)) + F.coalesce(f"_in_{k}", F.lit(0)) for k in sums}
    values |= {k: F.coalesce(F.last(f"_at_{k}", ignorenulls=True).over(upto), F.col(f"_in_{k}")) for k in lasts}
    return marked.join(states, [FILE, "_piece"]).select(*lines.columns, *(v.alias(k) for k, v in values.items()))
