"""MinHash near-dedup with HyperMinHash registers.

The first ``BUCKET_BITS`` bits of a shingle's 64-bit hash choose a bucket. Of the bucket's least hash its register keeps how many zeros the
remaining bits begin with, and the ``MANTISSA`` bits after the first one: 16 bits in place of 64, 0 for an empty bucket. Registers serve twice. ``BANDS`` bands of
``ROWS`` of them give the keys by which candidates meet (an empty bucket borrows the register of the first full one of an order of its own, so small
sets have whole bands too); and the share of equal registers, less the equal ones that chance gives to sets of those sizes, estimates the Jaccard
similarity of a candidate pair, which is verified on the whole sets unless the estimate is ``SIGMAS`` standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.durable import durable, stored
from . import blocks
from .nearcopies import set_hashes, shingle_sets
from .simhash import whole_runs
from .words import chunks, mix, texts_of

BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 20, 4  # a pair of a similarity of 0.85 shares no band with a chance of 4e-7, one of 0.8 with 3e-5
SIGMAS = 6.0
TOGETHER = 1 << 18  # shingles of loosely connected sets that are compared in one place; of more, each band is a place of its own
CELL = 1 << 21  # shingles of one band key that are compared in one place; a hotter key is dealt into pairs of blocks
_LEVELS = 64 - BUCKET_BITS
_ORDERS = np.argsort(np.random.default_rng(11).random((BANDS * ROWS, BUCKETS)), axis=1).astype(np.int64)
_ORDERS = np.concatenate([np.arange(BANDS * ROWS)[:, None], _ORDERS], axis=1)  # a bucket's own register comes first


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BUCKETS`` registers for each set; ``hashes`` are distinct and in order within a set."""
    out = np.zeros((len(first) - 1, BUCKETS), np.uint16)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = owner * BUCKETS + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    least = np.ones(len(hashes), bool)
    least[1:] = place[1:] != place[:-1]  # the first of a bucket is its least
    rest = hashes[least] << np.uint64(BUCKET_BITS)
    smeared = rest.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        smeared |= smeared >> np.uint64(shift)
    zeros = np.minimum(64 - np.bitwise_count(smeared).astype(np.int64), _LEVELS)
    after = rest << np.minimum(zeros + 1, 63).astype(np.uint64)
    out.reshape(-1)[place[least]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each row of registers, none of which may be of an empty set."""
    whole = np.zeros((len(regs), BANDS * ROWS), np.uint16)
    row, column = (x.ravel() for x in np.indices(whole.shape))
    step = 0
    while len(row):
        whole[row, column] = regs[row, _ORDERS[column, step]]
        empty = whole[row, column] == 0
        row, column = row[empty], column[empty]
        step += 1
    out = np.zeros((len(regs), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        band = k // ROWS
        out[:, band] = mix(out[:, band] + whole[:, k] + np.uint64((band + 1) << 20))
    return out


def level_chances(sizes: np.ndarray) -> np.ndarray:
    """For each set size, the chance that a bucket's least hash begins with so many zeros, by the number of zeros."""
    edges = np.concatenate([0.5 ** np.arange(_LEVELS + 1), [0.0]]) / BUCKETS
    above = np.exp(sizes[:, None] * np.log1p(-edges[None, :]))  # no hash of the bucket below the edge
    return above[:, 1:] - above[:, :-1]


def expected_collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers that disjoint sets share by chance, from rows of ``level_chances``: the same zeros, and the same mantissa once in 2**MANTISSA."""
    return (a * b).sum(axis=1) * BUCKETS / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, chances_a: np.ndarray, chances_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, buckets that it rests on) of rows of registers."""
    used = ((a | b) != 0).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.clip((equal - expected_collisions(chances_a, chances_b)) / np.maximum(used, 1), 0.0, 1.0), used


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        for a, b, body, offs in chunks(data, offsets):
            hashes, first = shingle_sets(body, offs)
            sizes = np.diff(first)
            full = sizes > 0
            keys = band_keys(registers(hashes, first)[full])
            ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            columns = [batch.column("doc_id").slice(a, b - a), batch.column("copy").slice(a, b - a), pa.array(set_hashes(hashes, first).view(np.int64)), pa.array(sizes.astype(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "size", "keys"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole shingle set and the registers of each row whose set is the node it was asked for."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        for a, b, body, offs in chunks(data, offsets):
            hashes, first = shingle_sets(body, offs)
            right = np.flatnonzero(set_hashes(hashes, first) == node[a:b])
            sets = [hashes[first[i] : first[i + 1]].tobytes() for i in right.tolist()]
            regs = [r.tobytes() for r in registers(hashes, first)[right]]
            yield pa.RecordBatch.from_arrays([pa.array(node[a:b][right].view(np.int64)), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())], ["node", "shingles", "registers"])


def similar(a: bytes, b: bytes, threshold: Fraction) -> bool:
    """Whether two sorted sets of 64-bit hashes have that Jaccard similarity at least, in whole numbers."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return threshold.denominator * common >= threshold.numerator * (len(a) + len(b) - common)


def _verified(threshold: Fraction, slack: float):
    """Of each cell, similar pairs that keep its similar sets connected (not every pair of a group).

    Candidates share a band; in a band's own cell, it is their first one, so no pair is compared in two bands.
    """
    level, rate = float(threshold), slack * float(threshold * (1 - threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell", 2000):
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            cell, node, band, sets = column("cell"), column("node"), column("band"), table.column("shingles").to_pylist()
            regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys, size = band_keys(regs), np.array([len(s) // 8 for s in sets])
            chances = level_chances(size).astype(np.float32)
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
                i = at[label[at] != label[at + step]]
                i = i[node[i] != node[i + step]]
                low, high = np.minimum(size[i], size[i + step]), np.maximum(size[i], size[i + step])
                i = i[threshold.denominator * low >= threshold.numerator * high]
                shared = keys[i] == keys[i + step]
                i = i[shared.any(axis=1) & ((band[i] < 0) | (shared.argmax(axis=1) == band[i]))]
                found, used = estimate(regs[i], regs[i + step], chances[i], chances[i + step])
                for k in i[found >= level - rate / np.sqrt(np.maximum(used, 1))].tolist():
                    u, v = root(k), root(k + step)
                    if u != v and similar(sets[k], sets[k + step], threshold):
                        label[max(u, v)] = min(u, v)
                        out.append((node[k], node[k + step]))
                while (label[label] != label).any():
                    label = label[label]
            if out:
                u, v = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        blocks.release()

    return run


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", slack: float = SIGMAS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id is component_id), a row for each row.

    Texts link where their sets of distinct five-word shingles (lower-cased A-Z; of fewer words the whole sequence) have the Jaccard similarity ``threshold``
    at least; links are confirmed on the whole sets. A text without words, null too, has an empty set and is linked with nothing. Equal sets are one node.
    Rows of a null doc_id link others; their component_id is the smallest id they reach, null if none, and ``kept`` then says true. Repeated rows are kept
    as they are; an empty table gives an empty result; other columns are not read.

    Sets that share a band are candidates. Loosely connected candidates meet in one place if they are few, and band by band, in pairs of blocks
    of ``CELL`` shingles, if they are many; which pairs are compared is the same in both. Set hashes and shingles have 64 bits.
    """
    texts = blocks.texts(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(_sketch, "doc_id long, copy long, node long, size long, keys array<long>"))
    nodes = durable(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "copy")).alias("one"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    postings = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    hubs = postings.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("load")).where("n > 1").drop("n")
    shared = durable(postings.join(hubs, ["band", "key"]))
    loose = connected_components(shared.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    sized = loose.join(nodes.select("node", "one", "size"), "node")
    loads = sized.groupBy("component").agg(F.sum("size").alias("whole"))
    asked = durable(sized.join(loads, "component").select("node", "one", "component", "whole"))
    few = asked.where(F.col("whole") <= TOGETHER).select("node", F.lit(-1).alias("band"), F.xxhash64("component").alias("cell"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    many = (
        shared.join(asked.where(F.col("whole") > TOGETHER).select("node"), "node")
        .withColumn("parts", F.expr(f"cast((load + {CELL - 1}) div {CELL} as int)"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "band", F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )
    wanted = asked.select(F.col("one.doc_id").alias("_id"), F.col("one.copy").alias("_copy"), "node")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("text", "node")
    sets = found.mapInArrow(_packed, "node long, shingles binary, registers binary").dropDuplicates(["node"])
    cells = few.unionByName(many).join(sets, "node").repartition("cell").sortWithinPartitions("cell")
    members = connected_components(durable(cells.mapInArrow(_verified(threshold, slack), "u long, v long")))  # links are read twice
    rooted = nodes.select("node", "least").join(members, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("reached")), "root").select("node", "reached")
    out = rows.select("doc_id", "node", "size").join(named, "node", "left")
    component = F.coalesce("reached", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """op11's contract: links at a similarity of 0.85."""
    return near_duplicates(docs, Fraction(17, 20))
