"""Near copies: SimHash fingerprints link texts as in op5, and the Jaccard similarity of distinct five-word shingles is verified on the whole sets.

Candidates are, first, the groups that ``simhash`` connects (four-word shingles, ``RADIUS`` bits). A radius that finds every pair of a similarity of 0.8 (a fingerprint of
shingles then differs in 10 of 64 bits on average, in 17 or more of them in one pair of a hundred) leaves pigeonring keys of so few bits that the join is quadratic. So further candidates share one of
``BANDS`` keys of ``ROWS`` minimum hashes, which a pair of a similarity of 0.8 fails to do with a chance of 0.00003 whatever
the edit looks like, and each candidate pair is verified by its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.durable import durable
from . import blocks
from .simhash import groups, prints_of, whole_runs
from .words import Words, chunks, mix, texts_of, windows

SIZE = 5
PRINT_WORDS, RADIUS, SEGMENTS = 4, 4, 7  # op5's shingles and links
BANDS, ROWS = 20, 4
TOGETHER = 1 << 18  # shingles of a group of candidates that is verified in one place, whatever its keys
CELL = 1 << 21  # shingles of one key that are compared in one place; a hotter key is dealt into pairs of blocks
_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of the texts one after the other, first of each text).

    Texts are lower-cased (A-Z); a text of fewer than ``SIZE`` words is one shingle, a text of none has an empty set.
    """
    words = Words(data, offsets, lower=True)
    hashes, _, counts = windows(words.hashes(), words.first, SIZE)
    own, few = words.counts(), np.flatnonzero((words.counts() > 0) & (words.counts() < SIZE))
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(few):
        plain, short = words.hashes(), np.zeros(len(few), np.uint64)
        for k in range(SIZE - 1):
            has = own[few] > k
            short[has] = mix(short[has] + plain[words.first[few[has]] + k] + np.uint64(k + 1))
        hashes, owner = np.concatenate([hashes, short]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[new], minlength=len(counts)) if len(owner) else np.zeros(len(counts), np.int64)
    return hashes[new], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 of an empty one."""
    sizes = np.diff(first)
    out, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), first[:-1][full]) + sizes[full].astype(np.uint64))
    return out


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set; sets may not be empty."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        band = k // ROWS
        out[:, band] = mix(out[:, band] + np.minimum.reduceat(hashes * factor, first[:-1]) + np.uint64(band + 1))
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        for a, b, body, offs in chunks(data, offsets):
            hashes, first = shingle_sets(body, offs)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            keys = band_keys(hashes, np.append(first[:-1][full], len(hashes))) if len(full) else np.zeros((0, BANDS), np.uint64)
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            prints = prints_of(body, offs, PRINT_WORDS, False).view(np.int64)
            columns = [batch.column("doc_id").slice(a, b - a), batch.column("copy").slice(a, b - a), pa.array(set_hashes(hashes, first).view(np.int64)), pa.array(sizes.astype(np.int64)), lists, pa.array(prints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "size", "keys", "f0"])
    blocks.release()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole shingle set of each row whose set is the node it was asked for."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        for a, b, body, offs in chunks(data, offsets):
            hashes, first = shingle_sets(body, offs)
            right = np.flatnonzero(set_hashes(hashes, first) == node[a:b])
            sets = [hashes[first[i] : first[i + 1]].tobytes() for i in right.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[a:b][right].view(np.int64)), pa.array(sets, pa.binary())], ["node", "shingles"])
    blocks.release()


def _similar(a: bytes, b: bytes, threshold: Fraction) -> bool:
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return threshold.denominator * common >= threshold.numerator * (len(a) + len(b) - common)


def _verified(threshold: Fraction):
    """Of each cell, similar pairs that keep its similar sets connected (not every pair of a group). Pairs share a key, in small groups as in large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell", 2000):
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            cell, node, sets = column("cell"), column("node"), table.column("shingles").to_pylist()
            size = np.array([len(s) for s in sets])
            keys = band_keys(np.frombuffer(b"".join(sets), np.uint64), np.concatenate([[0], np.cumsum(size // 8)]))
            keys = np.column_stack([keys, column("sim").view(np.uint64)])
            label = np.arange(len(cell))

            def root(i: int) -> int:
                while label[i] != i:
                    label[i] = label[label[i]]
                    i = label[i]
                return i

            out: list[tuple[int, int]] = []
            at, step = np.arange(len(cell)), 0
            while True:
                step += 1
                at = at[at + step < len(cell)]
                at = at[cell[at] == cell[at + step]]
                if not len(at):
                    break
                close = threshold.denominator * np.minimum(size[at], size[at + step]) >= threshold.numerator * np.maximum(size[at], size[at + step])
                i = at[close & (node[at] != node[at + step]) & (label[at] != label[at + step])]
                for i in i[(keys[i] == keys[i + step]).any(axis=1)].tolist():
                    u, v = root(i), root(i + step)
                    if u != v and _similar(sets[i], sets[i + step], threshold):
                        label[max(u, v)] = min(u, v)
                        out.append((node[i], node[i + step]))
            if out:
                u, v = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        blocks.release()

    return run


def print_groups(printed: DataFrame) -> DataFrame:
    """(node, sim) of the nodes (node, f0; a node may have several fingerprints) that SimHash links join: sim is the smallest node of the group."""
    linked = groups(printed.select(F.col("node").alias("doc_id"), "f0"), [RADIUS], SEGMENTS)
    return connected_components(linked.where("doc_id <> component_id"), "doc_id", "component_id").withColumnRenamed("component", "sim")


def least_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """component_id of each group of near copies: the smallest id of the texts that links of ``threshold`` connect.

    Equal sets are one node, texts without words one group. Nodes of one SimHash group or that share a band key (that group is one more key) are candidates; what they connect is
    verified in one place if it is small, and by key, in pairs of blocks of ``CELL``, if it is not. In both, every pair that shares a
    key is verified unless verified links connect it already, and no other pair.
    """
    texts = blocks.texts(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    prints = texts.mapInArrow(_prints, "doc_id long, copy long, node long, size long, keys array<long>, f0 long")
    # texts of one set may differ in how often a shingle comes, so a node may have several fingerprints
    printed = durable(prints.groupBy("node", "f0").agg(F.min(F.struct("doc_id", "copy")).alias("one"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    whole = printed.groupBy("node").agg(F.min("one").alias("one"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    sims = print_groups(printed.where("size > 0")).withColumnRenamed("node", "_node")
    nodes = durable(whole.join(sims, F.col("node") == F.col("_node"), "left").select("node", "one", "size", "keys", F.coalesce("sim", "node").alias("sim")))
    every = F.concat("keys", F.when(F.col("size") > 0, F.array(F.xxhash64("sim", F.lit(3)))).otherwise(F.array().cast("array<long>")))
    postings = nodes.select("node", "size", F.explode(every).alias("key"))
    hubs = postings.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("load")).where("n > 1").drop("n")
    shared = durable(postings.join(hubs, "key"))
    loose = connected_components(shared.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    sized = loose.join(nodes.select("node", "one", "size"), "node")
    loads = sized.groupBy("component").agg(F.sum("size").alias("all"))
    asked = durable(sized.join(loads, "component").select("node", "one", "component", F.col("all").alias("whole")))
    small = asked.where(F.col("whole") <= TOGETHER).select("node", F.xxhash64("component").alias("cell"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    large = (
        shared.join(asked.where(F.col("whole") > TOGETHER).select("node"), "node")
        .withColumn("parts", F.expr(f"cast((load + {CELL - 1}) div {CELL} as int)"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )
    wanted = asked.select(F.col("one.doc_id").alias("_id"), F.col("one.copy").alias("_copy"), "node")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("text", "node")
    sets = found.mapInArrow(_packed, "node long, shingles binary").dropDuplicates(["node"])
    cells = small.unionByName(large).join(sets, "node").join(nodes.select("node", "sim"), "node").repartition("cell").sortWithinPartitions("cell")
    members = connected_components(durable(cells.mapInArrow(_verified(threshold), "u long, v long")))  # links are read twice
    rooted = nodes.join(members, "node", "left").select(F.coalesce("component", "node").alias("root"), F.col("one.doc_id").alias("least"))
    return rooted.groupBy("root").agg(F.min("least").alias("component_id")).select("component_id")
