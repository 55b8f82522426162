"""Numbers and order statistics inside groups of any size.

Rows are cut into ranges by group and order, so a large group is dealt over many ranges. Counts by range, added up along a group, say which number a range begins with;
a row's number is that and its place in its range. No task holds more of a group than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import stored


def _ranges(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` with the number of their range of (keys, order), as ``_piece``; written, so that a task that runs again finds the same ranges. Equal rows share a range."""
    return stored(rows.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))


def _pieces(placed: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """For each group and range: _size, _before (of the group in earlier ranges) and _all. A group has a row for each of its ranges."""
    sizes = placed.groupBy(*keys, "_piece").agg(size.alias("_size"))
    by = Window.partitionBy(*keys)
    before = F.sum("_size").over(by.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("_size").over(by))


def _alike(keys: list[str]) -> Column:
    same = F.col("_piece") == F.col("_at")
    for k, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{k}"))
    return same


def _named(pieces: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return pieces.select(*(F.col(key).alias(f"_key{k}") for k, key in enumerate(keys)), F.col("_piece").alias("_at"), *columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... inside ``keys`` by ``order``, which should tell the rows of a group apart. Null keys are a group."""
    placed = _ranges(rows, keys, order)
    later = _named(_pieces(placed, keys, F.count("*")).where("_before > 0"), keys, "_before")
    place = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    joined = placed.withColumn("_place", place).join(F.broadcast(later), _alike(keys), "left")  # only the group that goes on into a range is there, so a row for each range at most
    return joined.select(*rows.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name))


def order_statistics(rows: DataFrame, keys: list[str], asked: dict[str, tuple[str, float | str]], weight: str | None = None) -> DataFrame:
    """``keys`` and a column for each of ``asked``: name -> (column, share of 0 to 1, or 'upper' for the upper median).

    Exact; a share between two values is interpolated linearly. Nulls don't count; a group without a value has null. Equal values are counted before they are
    cut into ranges, and only ranges that hold an asked rank are put in order. All measures go through together. A row with ``weight`` n (a whole number) counts n times.
    """
    columns = sorted({c for c, _ in asked.values()})
    measures = F.explode(F.array(*(F.struct(F.lit(k).alias("_m"), F.col(c).cast("double").alias("_v")) for k, c in enumerate(columns))))
    long = rows.select(*keys, (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), measures.alias("_x")).select(*keys, "_w", "_x._m", "_x._v")
    counts = long.where("_v is not null and _w > 0").groupBy(*keys, "_m", "_v").agg(F.sum("_w").alias("_n"))
    by = [*keys, "_m"]
    placed = _ranges(counts, by, ["_v"])
    ranks = {}
    for name, (column, share) in asked.items():
        at = F.lit(float(share)) * (F.col("_all") - 1) if share != "upper" else F.floor(F.col("_all") / 2).cast("double")
        ranks[name] = (columns.index(column), at, F.floor(at), F.ceil(at))
    wanted = None
    for m, _, low, high in ranks.values():
        holds = (F.col("_m") == m) & ((F.col("_before") <= low) & (low < F.col("_before") + F.col("_size")) | (F.col("_before") <= high) & (high < F.col("_before") + F.col("_size")))
        wanted = holds if wanted is None else wanted | holds
    pieces = _named(_pieces(placed, by, F.sum("_n")).where(wanted), by, "_before", "_all")
    held = placed.join(pieces, _alike(by)).select(*by, "_piece", "_v", "_n", "_before", "_all")
    upto = held.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_piece").orderBy("_v")))
    value = lambda m, rank: F.min(F.when((F.col("_m") == m) & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))
    found = upto.groupBy(*keys).agg(*(x for name, (m, at, low, high) in ranks.items() for x in (value(m, low).alias(f"{name}_low"), value(m, high).alias(f"{name}_high"), F.max(F.when(F.col("_m") == m, at - low)).alias(f"{name}_part"))))
    mixed = lambda n: F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(F.col(f"{n}_low") * (1 - F.col(f"{n}_part")) + F.col(f"{n}_high") * F.col(f"{n}_part"))
    return found.select(*keys, *(mixed(n).alias(n) for n in asked))


def joined_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, a row for each group, where the keys are alike; null is like null."""
    other = right.select(*(F.col(key).alias(f"_key{k}") for k, key in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{k}"))
    return left.join(other, same, "left").drop(*(f"_key{k}" for k in range(len(keys))))
