"""Density clusters of sky positions and merges of duplicate targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .components import connected_components
from .joins import place_pairs, places_of
from .stats import target_totals


def cluster_targets(targets: DataFrame, eps: float = 0.5, min_samples: int = 1) -> DataFrame:
    """id, cluster and core of DBSCAN over positions within ``eps`` degrees.

    A target with ``min_samples`` neighbours, itself counted, is a core. Linked cores are one cluster, named by its smallest id;
    others join the neighbouring cluster of the smallest name. What is left is noise: a cluster of its own. Targets of one position are one node that counts by
    their number, so copies make no pairs.
    """
    places = durable(places_of(targets))
    pairs = durable(place_pairs(places.select(F.col("place").alias("id"), F.col("_ra").alias("ra_deg"), F.col("_dec").alias("dec_deg")), eps).select("id_a", "id_b"))
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    sizes = places.select(F.col("place").alias("id_b"), "n").hint("merge")
    near = both.join(sizes, "id_b").groupBy("id_a").agg(F.sum("n").alias("others")).withColumnRenamed("id_a", "place")
    counted = durable(places.join(near.hint("merge"), "place", "left").withColumn("core", F.col("n") + F.coalesce("others", F.lit(0)) >= min_samples))
    cores = counted.where("core").select(F.col("place").alias("id"))
    end = lambda s: cores.withColumnRenamed("id", f"id_{s}").hint("merge")
    links = both.join(end("a"), "id_a").join(end("b"), "id_b")
    named = cores.join(connected_components(links, "id_a", "id_b").hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(named.withColumnRenamed("id", "id_b").hint("merge"), "id_b").groupBy("id_a").agg(F.min("cluster").alias("near"))
    of = counted.join(named.hint("merge"), F.col("place") == F.col("id"), "left").join(border.hint("merge"), F.col("place") == F.col("id_a"), "left")
    of = of.select("_ra", "_dec", "core", F.coalesce("cluster", "near").alias("cluster"))
    found = targets.join(of.hint("merge"), (F.col("ra_deg") == F.col("_ra")) & (F.col("dec_deg") == F.col("_dec")), "left")
    return found.select("id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("core", F.lit(min_samples <= 1)).alias("core"))


def cluster_summary(clusters: DataFrame, targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Members, mean direction, exposure and the name of the member with the most exposure. All tables grow with the targets, and a compressed file looks small, so none is broadcast."""
    a, d = F.radians("ra_deg"), F.radians("dec_deg")
    joined = clusters.join(targets.hint("merge"), "id").join(totals.select(F.col("target_id").alias("id"), "total_exposure").hint("merge"), "id", "left").withColumn("e", F.coalesce("total_exposure", F.lit(0.0)))
    sums = joined.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("e").alias("exposure"), F.max_by("name", F.struct("e", -F.col("id"))).alias("name"), F.sum(F.cos(d) * F.cos(a)).alias("x"), F.sum(F.cos(d) * F.sin(a)).alias("y"), F.sum(F.sin(d)).alias("z"))
    return sums.select("cluster", "members", "exposure", "name", F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("ra_deg"), F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("dec_deg"))


def merge_duplicates(targets: DataFrame) -> DataFrame:
    """id and keep: targets that are one object are kept as the smallest id.

    One object are targets of one canonical name; a target without one whose name, runs of spaces squeezed, is another's canonical name; and targets whose names
    differ only by a focal length, as in ' (455mm)', at their end. Merges are closed: what is linked through others is merged too. Null and '' are no canonical name.
    """
    squeezed = lambda c: F.regexp_replace(c, " +", " ")
    canonical, name = F.nullif(F.col("canonical_name"), F.lit("")), F.trim(F.regexp_replace("name", r"(?i)\s*\(\d+mm\)\s*$", ""))
    # each group's edges go to its smallest id, so a large group stays a star
    star = lambda key: targets.select("id", key.alias("k")).where("k is not null")
    edges = None
    for rows in (star(canonical), star(name)):
        own = rows.join(rows.groupBy("k").agg(F.min("id").alias("least")), "k").select("id", "least")
        edges = own if edges is None else edges.unionByName(own)
    known = star(squeezed(canonical)).groupBy("k").agg(F.min("id").alias("least"))
    orphans = targets.where(canonical.isNull()).select("id", squeezed(F.col("name")).alias("k")).join(known, "k").select("id", "least")
    found = connected_components(edges.unionByName(orphans), "id", "least")
    return targets.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("keep"))


def merged_tables(targets: DataFrame, observations: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a merge (id, keep): the kept targets, and observations of the kept ids.

    A kept target without a canonical name gets that of its group's first member (by id) that has one, and, where it has none, the first object type. A kept target
    with a canonical name keeps its own values. n_merged counts the targets that went into it.
    """
    canonical = F.nullif(F.col("canonical_name"), F.lit(""))
    joined = targets.join(keep, "id")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("id")))
    gone = joined.groupBy("keep").agg((F.count("*") - 1).alias("n_merged"), first(canonical).alias("_canonical"), first(F.col("object_type")).alias("_type"))
    kept = joined.where("id = keep").join(gone, "keep")
    filled = {"canonical_name": F.coalesce(canonical, "_canonical"), "object_type": F.when(canonical.isNull(), F.coalesce("object_type", "_type")).otherwise(F.col("object_type"))}
    moved = observations.join(keep.where("id <> keep").withColumnRenamed("id", "target_id"), "target_id", "left").withColumn("target_id", F.coalesce("keep", "target_id"))
    return kept.select(*(filled.get(c, F.col(c)).alias(c) for c in targets.columns), "n_merged"), moved.select(*observations.columns)


def merge_plan(targets: DataFrame, observations: DataFrame, merges: DataFrame) -> DataFrame:
    """What merges (source, dest) would do, nothing being changed: names, exposure and frames of both sides, observations_moved, and problem.

    problem is 'source not found', 'dest not found', 'same target' or null; only pairs without one are merged by ``merge_pairs``.
    """
    asked = merges.select("source", "dest").distinct()
    sums = observations.groupBy("target_id").agg(F.sum("exposure_time").alias("exposure"), F.sum("frame_count").alias("frames"), F.count("*").alias("n"))
    known = targets.select("id", "name", F.lit(True).alias("found")).join(sums, F.col("id") == F.col("target_id"), "left")
    side = lambda s: known.select(F.col("id").alias(s), F.col("name").alias(f"{s}_name"), F.col("exposure").alias(f"{s}_exposure"), F.col("frames").alias(f"{s}_frames"), F.col("n").alias(f"{s}_n"), F.col("found").alias(f"{s}_found"))
    joined = asked.join(side("source"), "source", "left").join(side("dest"), "dest", "left")
    problem = F.when(F.col("source_found").isNull(), "source not found").when(F.col("dest_found").isNull(), "dest not found").when(F.col("source") == F.col("dest"), "same target")
    zero = lambda c, kind: F.when(F.col(f"{c.split('_')[0]}_found"), F.coalesce(F.col(c), F.lit(0)).cast(kind)).alias(c)
    moved = F.when(problem.isNull(), F.coalesce("source_n", F.lit(0))).otherwise(0).cast("long").alias("observations_moved")
    sides = [x for s in ("source", "dest") for x in (F.col(s), F.col(f"{s}_name"), zero(f"{s}_exposure", "double"), zero(f"{s}_frames", "long"))]
    return joined.select(*sides, moved, problem.alias("problem"))


def merge_pairs(targets: DataFrame, observations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after all merges (source, dest) that ``merge_plan`` finds no problem with; targets have their totals computed anew.

    Chains are followed to their end, whatever their order; of several destinations of a source the smallest counts; of a circle the smallest id stays.
    """
    ids = targets.select("id").distinct()
    valid = merges.where("source <> dest").join(ids.withColumnRenamed("id", "source"), "source").join(ids.withColumnRenamed("id", "dest"), "dest")
    valid = durable(valid.groupBy("source").agg(F.min("dest").alias("dest")))
    groups = connected_components(valid, "source", "dest").join(valid.select(F.col("source").alias("node"), F.lit(True).alias("leaves")), "node", "left")
    ends = groups.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("leaves").isNull(), F.col("node"))), F.min("node")).alias("keep"))
    into = groups.join(ends, "component").where("node <> keep").select(F.col("node").alias("target_id"), "keep")
    moved = observations.join(into, "target_id", "left").withColumn("target_id", F.coalesce("keep", "target_id")).select(*observations.columns)
    kept = targets.join(into.select(F.col("target_id").alias("id")), "id", "left_anti")
    sums = target_totals(moved).withColumnRenamed("target_id", "id")
    filled = kept.join(sums, "id", "left").withColumns({"total_exposure": F.coalesce("total_exposure", F.lit(0.0)), "total_frames": F.coalesce("total_frames", F.lit(0)).cast("long")})
    return filled, moved
