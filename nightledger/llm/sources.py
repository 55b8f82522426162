"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_ROWS = 8192  # documents of a shard, of all sources together, on average
BROADCAST_SOURCES = 50_000  # a larger table of sources is joined by a shuffle
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), half_shares: int = 3, most: int = 2) -> DataFrame:
    """source, place (1, 2, ... by code point, null last), source_size and target, one row for each source of ``sizes``.

    Weights repeat along the sources. Targets share half_shares / 2 of all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again. Sorted by size for its weight, the stopped sources come first, so the
    level where the sharing ends follows from running sums. All comparisons are of whole numbers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    source = source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * 2 * most)  # in half words
    everything = Window.partitionBy()
    line = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    source = (
        source.withColumn("pool", F.sum("source_size").over(everything) * half_shares)
        .withColumn("taken_before", F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("pool") - F.col("taken_before")))
        .withColumn("rest", F.col("pool") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("rest_weight", F.sum(F.when(F.col("stops"), F.lit(0)).otherwise(F.col("weight"))).over(everything))
    )
    shared = (F.col("weight") * F.col("rest")).cast("double") / (2 * F.col("rest_weight"))
    return source.select("source", "place", "source_size", F.when(F.col("stops"), F.col("source_size") * float(most)).otherwise(shared).alias("target"))


def quotas(votes: DataFrame, block_words: int) -> DataFrame:
    """shard, place, quota: blocks that Sainte-Laguë gives each source of each shard of ``votes`` (shard, place, vote).

    A shard gets as many blocks as its votes make, rounded. Dividing by the block size gives the apportionment of some
    house size; the few blocks that are missing go to the highest quotients vote / (2 * seats + 1), and the few too many are
    taken from the lowest vote / (2 * seats - 1), which is the same as handing out all blocks by highest quotients.
    With m sources and d blocks to move no source gains or loses more than vote * (d + m) / votes + 1, so only those
    quotients are made.
    """
    shard = Window.partitionBy("shard")
    first = votes.withColumn("seats", F.floor(F.col("vote") / block_words + 0.5).cast("long"))
    first = first.withColumn("all_votes", F.sum("vote").over(shard)).withColumn("sources", F.count("*").over(shard))
    first = first.withColumn("move", F.floor(F.col("all_votes") / block_words + 0.5).cast("long") - F.sum("seats").over(shard))
    reach = F.ceil(F.col("vote") * (F.abs("move") + F.col("sources")) / F.col("all_votes")).cast("long") + 1
    steps = first.where("move <> 0 and vote > 0").withColumn("step", F.explode(F.sequence(F.lit(0), reach)))
    steps = steps.withColumn("after", F.when(F.col("move") > 0, F.col("seats") + F.col("step")).otherwise(F.col("seats") - F.col("step"))).where("move > 0 or after >= 1")
    quotient = F.when(F.col("move") > 0, -F.col("vote") / (2 * F.col("after") + 1)).otherwise(F.col("vote") / (2 * F.col("after") - 1))
    ranked = steps.withColumn("quotient", quotient).withColumn("rank", F.row_number().over(shard.orderBy("quotient", "place", "step")))
    moved = ranked.where(F.col("rank") <= F.abs("move")).groupBy("shard", "place").agg(F.sum(F.signum(F.col("move").cast("double"))).cast("long").alias("change"))
    return first.join(moved, ["shard", "place"], "left").select("shard", "place", (F.col("seats") + F.coalesce("change", F.lit(0))).alias("quota"))


def draws(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", together: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, size and draw of every row: a seeded hash of doc_id, text and, of rows that repeat both, their number.

    Repeated rows are counted before they are shuffled and taken apart in lots of ``together``, so they spread like any others. They are alike, so it
    doesn't matter which has which number.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("copy"))
    counted = rows.groupBy("doc_id", "source", "size", "copy").agg(F.count("*").alias("copies"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / together)))).repartition("doc_id", "source", "copy", "lot")
    each = lots.withColumn("number", F.explode(F.sequence(F.col("lot") * together, F.least("copies", (F.col("lot") + 1) * together) - 1)))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", F.col("number").cast("string")))
    return each.select("doc_id", "source", "size", draw.alias("draw"))


def shard_of(draw: str, shards: int) -> Column:
    return (F.conv(F.substring(draw, 1, 7), 16, 10).cast("long") % shards).cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many of its words the mix takes of each document: doc_id, size, source_size, target and taken.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Targets are those of ``source_targets``. Documents are
    dealt into shards by a seeded hash (``draws``), so that a source of any size spreads over all of them. In a shard each source's documents,
    in seeded order, are one stream of words cut into equal blocks; ``quotas`` says how many blocks the shard takes of it, and those
    are the first of the stream, which starts anew after its end. So no document is taken more than twice and the seed
    alone decides which are. Each source comes as near its target as half a block for each shard.

    Every row is kept, repeated rows as documents of their own; rows without a doc_id or with the same one are told apart by their texts.
    A source without words has target 0. Other columns are not read. Reruns agree.
    """
    sizes = durable(draws(docs, seed, id_col, text_col, source_col))
    shards = max(1, -(-sizes.count() // shard_rows))
    targets = durable(source_targets(sizes, weights))
    named = targets.withColumnRenamed("source", "name")
    named = F.broadcast(named) if targets.count() <= BROADCAST_SOURCES else named
    dealt = sizes.join(named, F.col("source").eqNullSafe(F.col("name")))
    dealt = dealt.withColumn("shard", shard_of("draw", shards))
    sums = dealt.groupBy("shard", "place").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("whole"), F.first("target").alias("goal"))
    votes = sums.select("shard", "place", "shard_size", F.when(F.col("whole") > 0, F.col("goal") * F.col("shard_size") / F.col("whole")).otherwise(0.0).alias("vote"))
    plan = quotas(votes, block_words).join(sums.select("shard", "place", "shard_size"), ["shard", "place"])
    plan = plan.withColumn("words", F.least(F.col("quota") * block_words, 2 * F.col("shard_size"))).select("shard", "place", "shard_size", "words")
    stream = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size")
    line = dealt.withColumn("before", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - whole * F.col("shard_size") - F.col("before")))
    return line.join(plan, ["place", "shard"]).select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """op8's contract."""
    return mix_sources(docs)


ORACLE = rf"""
WITH o AS (SELECT doc_id, source, text, md5(coalesce(text, '')) AS copy FROM documents),
s AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size, copy,
        row_number() OVER (PARTITION BY doc_id, source, copy) - 1 AS number FROM o),
n AS (SELECT greatest(1, CAST(ceil(count(*) / {SHARD_ROWS}.0) AS BIGINT)) AS shards FROM s),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
b AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 4 AS cap FROM a),
c AS (SELECT *, CAST(3 * sum(source_size) OVER () AS BIGINT) AS pool,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS taken_before,
        CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left FROM b),
d AS (SELECT *, cap * weight_left <= weight * (pool - taken_before) AS stops FROM c),
e AS (SELECT *, CAST(pool - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest,
        CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS BIGINT) AS rest_weight FROM d),
t AS (SELECT source, place, source_size, CASE WHEN stops THEN source_size * CAST(2 AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / (2 * rest_weight) END AS target FROM e),
g AS (SELECT s.doc_id, s.size, t.place, t.source_size, t.target, md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.copy || ':' || s.number) AS draw
        FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
h AS (SELECT g.*, CAST(('0x' || substr(draw, 1, 7)) AS BIGINT) % shards AS shard FROM g, n),
v AS (SELECT shard, place, CAST(sum(size) AS BIGINT) AS shard_size, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * CAST(sum(size) AS BIGINT) / any_value(source_size) ELSE CAST(0 AS DOUBLE) END AS vote FROM h GROUP BY shard, place),
w AS (SELECT *, CAST(floor(vote / {BLOCK_WORDS} + 0.5) AS BIGINT) AS seats, sum(vote) OVER (PARTITION BY shard) AS all_votes FROM v),
x AS (SELECT *, CAST(floor(all_votes / {BLOCK_WORDS} + 0.5) - sum(seats) OVER (PARTITION BY shard) AS BIGINT) AS move FROM w),
y AS (SELECT *, unnest(range(0, abs(move) + 1)) AS step FROM x WHERE move <> 0 AND vote > 0),
z AS (SELECT *, CASE WHEN move > 0 THEN seats + step ELSE seats - step END AS after FROM y),
q AS (SELECT shard, place, move, row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN move > 0 THEN -vote / (2 * after + 1) ELSE vote / (2 * after - 1) END, place, step) AS rank FROM z WHERE move > 0 OR after >= 1),
m AS (SELECT shard, place, sum(sign(move)) AS change FROM q WHERE rank <= abs(move) GROUP BY shard, place),
p AS (SELECT x.shard, x.place, x.shard_size, CAST(least((seats + coalesce(change, 0)) * {BLOCK_WORDS}, 2 * shard_size) AS BIGINT) AS words FROM x LEFT JOIN m ON x.shard = m.shard AND x.place = m.place),
l AS (SELECT h.*, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM h)
SELECT l.doc_id, CAST(l.size AS BIGINT) AS size, l.source_size, l.target,
  CAST(CASE WHEN p.shard_size > 0 THEN (words // p.shard_size) * l.size + greatest(0, least(l.size, words % p.shard_size - l.before)) ELSE 0 END AS BIGINT) AS taken
FROM l JOIN p ON l.place = p.place AND l.shard = p.shard
"""
