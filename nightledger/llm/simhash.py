"""SimHash near-dedup with the pigeonring filter.

Fingerprints of 64 bits are cut into ``segments`` arranged in a ring. Two fingerprints that differ in at most
``radius`` bits agree wholly in at least ``segments - radius`` of them, which gives the candidate keys; and some
chain of consecutive segments starts where each of its prefixes of l segments differs in at most
floor(l * radius / segments) bits, which prunes the candidates before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.durable import durable
from . import blocks
from .words import chunks, texts_of

CELL = 1024  # fingerprints of one key that are compared in one place; a hotter key is split into pairs of blocks
_LANES = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group ``hashes[first[i]:first[i+1]]``: the bits set in over half of it; zero for an empty group."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # eight counters of one byte in each word, so at most 255 hashes are added before the counters are spread out
    pieces = -(-counts[full] // 255)
    piece_group = np.repeat(np.arange(len(full)), pieces)
    within = np.arange(len(piece_group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][full][piece_group] + 255 * within
    group_at = np.cumsum(pieces) - pieces
    half = counts[full][:, None]
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), group_at, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > half[:, 0]).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def _shingle_hashes(text: bytes, size: int, distinct: bool) -> list[int]:
    text = b" ".join(text.lower().split())  # bytes: A-Z and the six ASCII spaces only
    if not text:
        return []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(text)]
    digest = xxhash.xxh64_intdigest
    pieces = [text[s:e] for s, e in zip(starts, ends[size - 1 :])] if len(starts) >= size else [text]
    return [digest(x, 42) for x in (set(pieces) if distinct else pieces)]


def prints_of(body: np.ndarray, offs: np.ndarray, size: int, distinct: bool) -> np.ndarray:
    """The fingerprint of each text ``body[offs[i]:offs[i+1]]``; see ``fingerprints``."""
    raw = body.tobytes()
    groups = [_shingle_hashes(raw[s:e], size, distinct) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
    first = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64)
    return bit_majority(np.fromiter((h for g in groups for h in g), np.uint64, int(first[-1])), first)


def fingerprints(docs: DataFrame, shingles: list[tuple[int, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a fingerprint f0, f1, ... for each (words in a shingle, count each shingle once).

    Texts are lower-cased (A-Z); words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one shingle; a text of none,
    and null, has fingerprint zero. A shingle's hash is XXH64 with seed 42 of its words joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            columns = [[] for _ in shingles]
            for _, _, body, offs in chunks(data, offsets):
                for column, (size, distinct) in zip(columns, shingles):
                    column.append(prints_of(body, offs, size, distinct))
            arrays = [pa.array(np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(f"f{k}" for k in range(len(shingles)))])

    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(len(shingles)))
    return blocks.texts(docs, id_col, text_col).mapInArrow(run, schema)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def viable(differ: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Whether a ring chain of each xor stays within its proportional budgets."""
    parts = [np.bitwise_count(differ & np.uint64(((1 << w) - 1) << at)).astype(np.int16) for at, w in _cuts(segments)]
    found = np.zeros(len(differ), bool)
    for i in range(segments):
        alive, total = np.ones(len(differ), bool), np.zeros(len(differ), np.int16)
        for l in range(1, segments + 1):
            total = total + parts[(i + l - 1) % segments]
            alive &= total <= l * radius // segments
        found |= alive
    return found


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 100_000) -> Iterator[pa.Table]:
    """Tables that hold every row of the keys in them, from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _links(radii: list[int], segments: int):
    """Of each cell, links that keep its linked fingerprints connected (not every pair of a group)."""
    names = [f"f{k}" for k in range(len(radii))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            cell, node = column("cell"), column("node")
            prints = [column(c).view(np.uint64) for c in names]
            label = np.arange(len(cell))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            at, step = np.arange(len(cell)), 0
            while True:
                step += 1
                at = at[at + step < len(cell)]
                at = at[cell[at] == cell[at + step]]
                if not len(at):
                    break
                i = at[label[at] != label[at + step]]
                i = i[node[i] != node[i + step]]
                differ = prints[0][i] ^ prints[0][i + step]
                i = i[viable(differ, radii[0], segments)]
                for p, r in zip(prints, radii):
                    i = i[np.bitwise_count(p[i] ^ p[i + step]) <= r]
                if not len(i):
                    continue
                out.append((node[i], node[i + step]))
                low, high = np.minimum(label[i], label[i + step]), np.maximum(label[i], label[i + step])
                parent = np.arange(len(cell))
                np.minimum.at(parent, high, low)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                label = parent[label]
            if out:
                u, v = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def groups(prints: DataFrame, radii: list[int], segments: int) -> DataFrame:
    """``prints`` (doc_id, f0, ...) with component_id: the smallest doc_id reachable over links.

    Two fingerprint tuples link where each f<k> differs in at most radii[k] bits; candidates come from f0 alone, exactly.
    Copies count as one node, so a group of exact copies costs nothing; a key shared by many nodes is dealt out in pairs of
    blocks of ``CELL``. Null doc_ids keep their rows; their component_id is the smallest doc_id they link to, null if none.
    """
    if segments <= radii[0]:
        raise ValueError("as many segments as radius + 1 are needed at least")
    names = [f"f{k}" for k in range(len(radii))]
    node = F.col("f0") if len(radii) == 1 else F.xxhash64(*names)
    nodes = durable(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", node))
    cuts = _cuts(segments)
    keys = []
    for c, chosen in enumerate(combinations(range(segments), segments - radii[0])):
        key, shift = F.lit(c << 40), 0
        for s in chosen:
            at, width = cuts[s]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("f0", at).bitwiseAND(F.lit((1 << width) - 1)), shift))
            shift += width
        keys.append(key)
    postings = nodes.select("node", *names, F.explode(F.array(*keys)).alias("key"))
    shared = postings.groupBy("key").count().where("count > 1").select("key", F.expr(f"cast((count + {CELL - 1}) div {CELL} as int)").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    cells = (
        postings.join(shared, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", *names, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell")
    edges = sorted_cells.mapInArrow(_links(radii, segments), "u long, v long")
    members = connected_components(edges)
    rooted = nodes.join(members, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(*[F.col(c).alias(f"n_{c}") for c in names], "component_id")
    same = [F.col(c) == F.col(f"n_{c}") for c in names]
    condition = same[0] if len(same) == 1 else same[0] & same[1]
    return prints.join(named, condition).select("doc_id", *names, "component_id")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, radius: int = 4, segments: int = 7) -> DataFrame:
    """doc_id, f0 (fingerprint as a signed long) and component_id; see ``fingerprints`` and ``groups``.

    Every row is kept, repeated rows and empty texts included; an empty table gives an empty result; other columns are not read.
    """
    return groups(durable(fingerprints(docs, [(size, False)], id_col, text_col)), [radius], segments)


def digest(docs: DataFrame) -> DataFrame:
    """op5's contract: four-word shingles, links at four bits."""
    found = near_duplicate_groups(docs, size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
