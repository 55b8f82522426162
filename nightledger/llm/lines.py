"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity over the whole corpus, so that two lines of a Jaccard similarity
of ``threshold`` share a word within their short prefixes. Postings of prefix words meet by word; length, position and sketch
filters leave few pairs, whose lines are then sent again with all their words and verified. A line goes if an earlier
line of the input is similar to it; of equal sets the first line stands for all, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import CHUNK, Words, chunks, mix, string_column, texts_of

SLOT_BITS = 20  # of the tables that count words and prefix words; shared slots only make the order less sharp
CELL = 4096  # postings of one prefix word that are compared in one place; more are dealt into pairs of blocks
_HASH = np.uint64((1 << 36) - 1)  # words are told apart by 36 bits inside a pair of lines
SKETCH = 96  # bits of a set's odd sketch
_SEGMENT = 1 << 15
_POSTING = np.dtype([("key", "<u4"), ("set0", "<u4"), ("set1", "<u2"), ("odd0", "<u8"), ("odd1", "<u4")])  # packed: most of what is sent
_SETS = np.uint64((1 << 48) - 1)  # postings tell sets apart by 48 bits, keys within a partition by 32
_FULL = np.dtype([("key", "<u8"), ("set", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4"), ("ref", "<i4")])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Breaks:
    """Where the lines of some texts end; ``counts`` are each text's lines, ``owner`` is each line's text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.before = np.searchsorted(np.flatnonzero(data == 10), offsets)
        self.counts = np.diff(self.before) + 1
        self.owner = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each text without the lines marked in ``gone``."""
        raw, out = self.data.tobytes(), []
        at = 0
        for a, b, n in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), self.counts.tolist()):
            own = gone[at : at + n]
            out.append(raw[a:b] if not own.any() else b"\n".join([x for x, g in zip(raw[a:b].split(b"\n"), own) if not g]))
            at += n
        return out


class Lines(Breaks):
    """Lines with their words; ``filled`` are the lines that have any."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self.words = Words(data, offsets, lower=True)
        base = np.concatenate([[0], np.cumsum(self.counts)])
        text = self.words.text()
        of = (base[:-1] - self.before[:-1])[text] + np.cumsum(data == 10, dtype=np.int32)[self.words.start]
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        self.filled = of[new]
        self.of = np.cumsum(new) - 1  # the filled line of each word
        self.whole = self.words.hashes()
        self.hashes = self.whole & _HASH

    def sets(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words of the filled lines one after the other, first of each line), rarest first; and their 64-bit hashes."""
        out, whole, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(len(self.filled), np.int64)
        for a in range(0, len(self.filled), 1 << 20):  # a line's number takes 20 bits of the sort key
            lo, hi = np.searchsorted(self.of, [a, a + (1 << 20)])
            key = ((self.of[lo:hi] - a).astype(np.uint64) << np.uint64(44)) | self.hashes[lo:hi]
            key |= rarity[_slot(self.hashes[lo:hi])].astype(np.uint64) << np.uint64(36)
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if len(key):  # of two words of a line that agree in 36 bits the larger hash, in whatever order they came
                whole.append(np.maximum.reduceat(self.whole[lo:hi][order], np.flatnonzero(new)))
            key = key[new]
            own = np.bincount((key >> np.uint64(44)).astype(np.intp))
            sizes[a : a + len(own)] = own
            out.append(key & _HASH)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(whole)


def set_ids(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set from the 64-bit hashes of its words; every set has a token."""
    if len(first) < 2:
        return np.zeros(0, np.uint64)
    return mix(np.add.reduceat(mix(tokens), first[:-1]) + np.diff(first).astype(np.uint64))


class Filter:
    """The bounds that follow from a Jaccard similarity of num / den, in whole numbers."""

    def __init__(self, threshold: Fraction):
        self.num, self.den = threshold.numerator, threshold.denominator

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Words to index; none for sets so small that only an equal set is similar."""
        length = size + (-self.num * size) // self.den + 1
        return np.where(size * (self.den - self.num) >= self.num, length, 0)

    def shorter(self, size: np.ndarray) -> np.ndarray:
        """Of that prefix, the part in which the shorter of two similar sets has a word of the longer's prefix."""
        return size + (-2 * self.num * size) // (self.num + self.den) + 1

    def enough(self, overlap, a, b):
        return (self.num + self.den) * overlap >= self.num * (a + b)

    def lengths(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def positions(self, size_a, at_a, size_b, at_b):
        return self.enough(np.minimum(size_a - at_a, size_b - at_b), size_a, size_b)

    def sketches(self, differing_bits, a, b):
        """A word of one line only flips one bit of the sketch, so no more bits differ than words do."""
        return differing_bits * (self.num + self.den) <= (self.den - self.num) * (a + b)


def _prefixes(tokens: np.ndarray, first: np.ndarray, chosen: np.ndarray, bounds: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, position, word) of the prefix words of the chosen lines."""
    size = np.diff(first)
    n = np.where(chosen, bounds.prefix(size), 0)
    line = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    return line, at, tokens[first[line] + at]


def _cells(word: np.ndarray, chosen_by: np.ndarray, load: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(posting, key): each posting once, or for each pair of blocks that its own block is in where the word is common."""
    parts = np.maximum(1, -(-load[_slot(word)].astype(np.int64) // cell))
    index = np.repeat(np.arange(len(word)), parts)
    other = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (mix(chosen_by[index] + np.uint64(77)) % parts[index].astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) << 24 | np.maximum(own, other)).astype(np.uint64)
    return index, mix(word[index] + mix(pair))


def _counted(docs: DataFrame, tasks: int, slots_of) -> np.ndarray:
    """How often each slot comes in ``slots_of(bytes, offsets)`` of all rows, a table of 2**SLOT_BITS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for _, _, body, offs in chunks(data, offsets):
                np.add.at(total, slots_of(body, offs), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        for a in range(0, len(total), _SEGMENT):
            if total[a : a + _SEGMENT].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([a // _SEGMENT], pa.int32()), "counts": [pack(total[a : a + _SEGMENT].tobytes())]})
        del total
        blocks.release()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"segment": table.column("segment").slice(0, 1).combine_chunks(), "counts": [total.tobytes()]})

    parts = docs.select("text").coalesce(tasks).mapInArrow(run, "segment int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for segment, counts in parts.groupBy("segment").applyInArrow(add, "segment int, counts binary").collect():
        out[segment * _SEGMENT : (segment + 1) * _SEGMENT] = np.frombuffer(counts, np.int64)
    return out


def _rows(part: np.ndarray, count: int, block: int, **columns) -> pa.Table:
    """One row for each partition with the packed items of each column."""
    order, bounds = blocks.slices(part, count)
    full = [p for p in range(count) if bounds[p + 1] > bounds[p]]
    packed = {k: pa.array([v[order[bounds[p] : bounds[p + 1]]].tobytes() for p in full], pa.binary()) for k, v in columns.items()}
    return pa.table({"part": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), **packed})


def _ascending(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, packed by their steps."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype("<u8"), prepend=np.uint64(0)).tobytes())


def _unpacked(values: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(values), np.uint64)).astype(np.int64)


def _block_lines(table: pa.Table, rarity: np.ndarray):
    """(doc_ids in order, [(first text, lines, tokens, first, ids of sets)]) of a block."""
    order, ids = blocks.in_order(table)
    data, offsets = texts_of(table.column("text").take(pa.array(order)))
    parts = []
    for a, _, body, offs in chunks(data, offsets, CHUNK):
        lines = Lines(body, offs)
        tokens, first, whole = lines.sets(rarity)
        parts.append((a, lines, tokens, first, set_ids(whole, first)))
    return ids, parts


def _runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(places i, step) such that i and i + step have one key, for every step; ``key`` is sorted."""
    at, step = np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if len(at):
            yield at, step


def _meeting(sets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Names a posting by its set and key, of which the parts count that postings hold."""
    return mix((sets & _SETS) ^ mix(keys & np.uint64(0xFFFFFFFF)))


def _short(tokens: np.ndarray) -> bytes:
    """36-bit numbers in five bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(packed: np.ndarray) -> np.ndarray:
    """The numbers of rows of five bytes."""
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :5] = packed
    return out.view("<u8").ravel()


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("postings", pa.binary()), ("shape", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("lines", pa.binary())])


def _sent(**columns) -> pa.Table:
    n = len(columns["part"])
    return pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in _SENT], _SENT)


def _post(model, count: int):
    """Three kinds of rows, told apart by what is null: postings of prefix words by the word's partition; each set of the
    block, with its first line and that line's document, by the set's partition; and, without keys, the lines that repeat a set of the block."""

    def run(table: pa.Table) -> pa.Table:
        blocks.release()
        rarity, load, bounds, cell = model.value
        block = table.column("block")[0].as_py()
        ids_in_order, parts = _block_lines(table, rarity)
        out, shape, keys, seen = [np.zeros(0, _POSTING)], [np.zeros((0, 2), np.int32)], [np.zeros(0, np.uint64)], np.zeros(0, np.uint64)
        sets_of, docs_of, lines_of, repeats, above = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for a, lines, tokens, first, ids in parts:
            new, at = np.unique(ids, return_index=True)
            fresh = np.zeros(len(ids), bool)
            fresh[at[~np.isin(new, seen)]] = True
            seen = np.union1d(seen, new)
            own_line = above + lines.filled
            sets_of.append(ids[fresh])
            docs_of.append(ids_in_order[a + lines.owner[lines.filled[fresh]]])
            lines_of.append(own_line[fresh])
            repeats.append(own_line[~fresh])
            above += len(lines.owner)
            line, place, word = _prefixes(tokens, first, fresh, bounds)
            index, key = _cells(word, ids[line], load, cell)
            post = np.zeros(len(index), _POSTING)
            line = line[index]
            sets = ids[line]
            post["key"], post["set0"], post["set1"] = key & np.uint64(0xFFFFFFFF), sets & np.uint64(0xFFFFFFFF), (sets >> np.uint64(32)) & np.uint64(0xFFFF)
            if len(ids):
                bit = (mix(tokens) >> np.uint64(32)) % np.uint64(SKETCH)
                for name, low in (("odd0", 0), ("odd1", 64)):
                    inside = (bit >= low) & (bit < low + 64)
                    flips = np.where(inside, np.uint64(1) << ((bit - np.uint64(low)) & np.uint64(63)), np.uint64(0))
                    post[name] = np.bitwise_xor.reduceat(flips, first[:-1])[line]
            out.append(post)
            shape.append(np.stack([np.diff(first)[line], place[index]], axis=1).astype(np.int32))
            keys.append(key)
        post, shape, keys, sets_of, docs_of, lines_of, repeats = map(np.concatenate, (out, shape, keys, sets_of, docs_of, lines_of, repeats))
        pack = zstandard.ZstdCompressor(level=1).compress
        posted = _rows(blocks.partition_of(keys, count), count, block, postings=post, shape=shape)
        posted = _sent(part=posted["part"], block=posted["block"], postings=posted["postings"], shape=pa.array([pack(x) for x in posted["shape"].to_pylist()], pa.binary()))
        order, edges = blocks.slices(blocks.partition_of(sets_of, count), count)
        full = np.flatnonzero(np.diff(edges)).tolist()
        own = [order[edges[p] : edges[p + 1]] for p in full]
        packed = lambda c: pa.array([_ascending(c[x]) for x in own], pa.binary())
        listed = _sent(part=pa.array(full, pa.int32()), block=pa.array([block] * len(full), pa.int32()), keys=pa.array([sets_of[x].tobytes() for x in own], pa.binary()), docs=packed(docs_of), lines=packed(lines_of))
        again = [_ascending(repeats)] if len(repeats) else []
        repeated = _sent(part=pa.array([block % count] * len(again), pa.int32()), block=pa.array([block] * len(again), pa.int32()), lines=pa.array(again, pa.binary()))
        return pa.concat_tables([posted, listed, repeated])

    return run


def _having(table: pa.Table, column: str) -> list[int]:
    """The rows in which a column is not null."""
    return np.flatnonzero(table.column(column).is_valid().to_numpy()).tolist()


def _candidates(bounds: Filter):
    """Of each block's postings, those that pass the filters with any other set's."""

    def run(table: pa.Table) -> pa.Table:
        blocks.release()
        rows = _having(table, "postings")
        column = lambda c: (table.column(c)[k] for k in rows)
        lists = _parts(column("postings"), _POSTING)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        post = np.concatenate([np.zeros(0, _POSTING), *lists])
        shape = np.concatenate([np.zeros((0, 2), np.int32), *(np.frombuffer(zstandard.decompress(x.as_py()), np.int32).reshape(-1, 2) for x in column("shape"))])
        order = np.argsort(post["key"])
        key = post["key"][order]
        alone = np.ones(len(key), bool)
        same = key[1:] == key[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        order = order[~alone]
        own, odd0, odd1 = owner[order], np.ascontiguousarray(post["odd0"][order]), np.ascontiguousarray(post["odd1"][order])
        sets = post["set0"][order].astype(np.uint64) | post["set1"][order].astype(np.uint64) << np.uint64(32)
        key, size, at = post["key"][order].astype(np.uint64), shape[order, 0].astype(np.int64), shape[order, 1].astype(np.int64)
        short = at < bounds.shorter(size)
        hit = np.zeros(len(order), bool)
        for i, step in _runs(key):
            j = i + step
            go = ~(hit[i] & hit[j]) & (sets[i] != sets[j]) & bounds.lengths(size[i], size[j])
            i = i[go]
            j = i + step
            bits = np.bitwise_count(odd0[i] ^ odd0[j]).astype(np.int64) + np.bitwise_count(odd1[i] ^ odd1[j])
            go = bounds.sketches(bits, size[i], size[j]) & bounds.positions(size[i], at[i], size[j], at[j]) & np.where((size[i] < size[j]) | ((size[i] == size[j]) & (sets[i] < sets[j])), short[i], short[j])
            hit[i[go]] = hit[j[go]] = True
        names = [x.as_py() for x in column("block")]
        met = _meeting(sets, key)
        found = {b: np.unique(met[hit & (own == b)]) for b in np.unique(own[hit])}
        return pa.table({"block": pa.array([names[b] for b in found], pa.int32()), "sets": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    return run


def _post_whole(model, count: int):
    """The postings that passed once more, with order and all words."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        blocks.release()
        rarity, load, bounds, cell = model.value
        empty = pa.table({c: pa.array([], t) for c, t in (("part", pa.int32()), ("block", pa.int32()), ("postings", pa.binary()), ("tokens", pa.binary()), ("sizes", pa.binary()))})
        if not asked.num_rows or not table.num_rows:
            return empty
        want = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in asked.column("sets").to_pylist()]))
        block = table.column("block")[0].as_py()
        docs, parts = _block_lines(table, rarity)
        rows = {p: ([], [], []) for p in range(count)}
        done, above = np.zeros(0, np.uint64), 0
        for a, lines, tokens, first, ids in parts:
            new, at = np.unique(ids, return_index=True)
            chosen = np.zeros(len(ids), bool)
            chosen[at[~np.isin(new, done)]] = True
            done = np.union1d(done, new)
            line, place, word = _prefixes(tokens, first, chosen, bounds)
            index, key = _cells(word, ids[line], load, cell)
            line, place = line[index], place[index]
            asked_for = np.isin(_meeting(ids[line], key), want)
            line, place, key = line[asked_for], place[asked_for], key[asked_for]
            post = np.zeros(len(line), _FULL)
            whole = lines.filled[line]
            post["key"], post["set"], post["size"], post["at"] = key, ids[line], np.diff(first)[line], place
            post["doc"], post["line"] = docs[a + lines.owner[whole]], above + whole  # rows of one doc_id follow one another
            above += len(lines.owner)
            order, edges = blocks.slices(blocks.partition_of(key, count), count)
            for p in np.flatnonzero(np.diff(edges)):
                own = order[edges[p] : edges[p + 1]]
                each, ref = np.unique(line[own], return_inverse=True)  # a line's words are sent to a partition once
                post["ref"][own] = ref + sum(map(len, rows[p][2]))
                size = np.diff(first)[each]
                rows[p][0].append(post[own])
                rows[p][1].append(tokens[np.repeat(first[each] - np.cumsum(size) + size, size) + np.arange(size.sum())])
                rows[p][2].append(size.astype(np.int32))
        full = [p for p, (x, *_) in rows.items() if x]
        return pa.table({"part": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "postings": pa.array([np.concatenate(rows[p][0]).tobytes() for p in full], pa.binary()), "tokens": pa.array([_short(np.concatenate(rows[p][1])) for p in full], pa.binary()), "sizes": pa.array([np.concatenate(rows[p][2]).tobytes() for p in full], pa.binary())}, empty.schema)

    return run


def _overlaps(tokens: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that lines i and j have in common; ``tokens`` are words as ``_short`` packs them, five bytes each."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 20_000):
        keys = []
        for rows in (i[a : a + 20_000], j[a : a + 20_000]):
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            keys.append((np.repeat(np.arange(len(rows)), size).astype(np.uint64) << np.uint64(36)) | _long(tokens[at]))
        keys = np.sort(np.concatenate(keys))
        both = keys[1:][keys[1:] == keys[:-1]]
        out[a : a + 20_000] = np.bincount((both >> np.uint64(36)).astype(np.int64), minlength=len(i[a : a + 20_000]))
    return out


def _parts(column, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays, without a copy."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _slices(key: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of sorted keys, about ``most`` long, that part no key."""
    a = 0
    while a < len(key):
        b = min(len(key), a + most)
        b = int(np.searchsorted(key, key[b - 1], "right"))
        yield slice(a, b)
        a = b


def _verified(bounds: Filter, count: int):
    """Sets that have a similar set whose first line is earlier, dealt by set. Keys are gone through some ten thousands of postings at a time."""

    def run(table: pa.Table) -> pa.Table:
        blocks.release()
        lists = _parts(table.column("postings"), _FULL)
        sizes = _parts(table.column("sizes"), np.int32)
        n = [len(x) for x in lists]
        block = np.repeat(table.column("block").to_numpy(), n)
        ref = np.repeat(np.cumsum([0, *map(len, sizes)])[:-1], n)
        post = np.concatenate(lists)
        tokens = np.concatenate(_parts(table.column("tokens"), np.uint8)).reshape(-1, 5)
        bound = np.concatenate([[0], np.cumsum(np.concatenate(sizes).astype(np.int64))])
        by_key = np.argsort(post["key"], kind="stable")
        found = [np.zeros(0, np.uint64)]
        for now in _slices(post["key"][by_key], 60_000):
            own = by_key[now]
            part = post[own]
            order = np.lexsort((part["line"], block[own], part["doc"], part["set"], part["key"]))
            same = (part["key"][order][1:] == part["key"][order][:-1]) & (part["set"][order][1:] == part["set"][order][:-1])
            order = order[np.concatenate([[True], ~same])]  # of a set's lines the earliest
            order = order[np.lexsort((part["line"][order], block[own][order], part["doc"][order], part["key"][order]))]
            key, sets, size, at = (np.ascontiguousarray(part[c][order]) for c in ("key", "set", "size", "at"))
            size, at, low = size.astype(np.int64), at.astype(np.int64), bound[part["ref"][order] + ref[own][order]]
            gone = np.zeros(len(order), bool)
            for i, step in _runs(key):
                i = i[~gone[i + step]]
                j = i + step
                i = i[bounds.lengths(size[i], size[j]) & bounds.positions(size[i], at[i], size[j], at[j])]
                if len(i):
                    j = i + step
                    overlap = _overlaps(tokens, np.stack([low, low + size]).T.ravel(), 2 * i, 2 * j)
                    gone[j[bounds.enough(overlap, size[i], size[j])]] = True
            found.append(np.unique(sets[gone]))
        found = np.unique(np.concatenate(found))
        blocks.release()
        out = _rows(blocks.partition_of(found, count), count, 0, sets=found)
        return out.select(["part", "sets"])

    return run


def _judge(sent: pa.Table, similar: pa.Table) -> pa.Table:
    """The lines of each block that go: those whose set another block holds in an earlier document, or in an earlier block of
    it, or has an earlier similar set; and those that repeat a set of their block."""
    listed = _having(sent, "keys")
    column = lambda c: (sent.column(c)[k].as_py() for k in listed)
    each = _parts((sent.column("keys")[k] for k in listed), np.uint64)
    keys, doc = np.concatenate([np.zeros(0, np.uint64), *each]), np.concatenate([np.zeros(0, np.int64), *map(_unpacked, column("docs"))])
    bad = np.concatenate([np.zeros(0, np.uint64), *_parts(similar.column("sets"), np.uint64)])
    names = list(column("block"))
    block = np.repeat(np.array(names, np.int64), [len(x) for x in each])
    order = np.lexsort((block, doc, keys))
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    gone = later | np.isin(keys, bad)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    answers = [(name, _ascending(_unpacked(lines)[gone[a:b]])) for name, lines, a, b in zip(names, column("lines"), edges, edges[1:]) if gone[a:b].any()]
    plain = set(_having(sent, "lines")).difference(listed)
    answers += [(sent.column("block")[k].as_py(), sent.column("lines")[k].as_py()) for k in sorted(plain)]
    blocks.release()
    return pa.table({"block": pa.array([a for a, _ in answers], pa.int32()), "lines": pa.array([x for _, x in answers], pa.binary())})


def _cut(table: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's texts without the lines that go."""
    order, _ = blocks.in_order(table)
    data, offsets = texts_of(table.column("text").take(pa.array(order)))
    lines = Breaks(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    gone = np.zeros(len(lines.owner), bool)
    for x in answers.column("lines"):
        gone[_unpacked(x.as_py())] = True
    kept = string_column(lines.kept(gone))
    blocks.release()
    own = {c: table.column(c).take(pa.array(order)) for c in ("doc_id", "rest") if c in table.column_names}
    return pa.table({"doc_id": own.pop("doc_id"), "n_lines": lines.counts, "n_removed": np.bincount(lines.owner[gone], minlength=len(lines.counts)), "text": kept, **own})


def dedup_lines(docs: DataFrame, threshold: Fraction = Fraction(4, 5), cell: int = CELL, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Removes every line whose word set has a Jaccard similarity of ``threshold`` or more with an earlier line.

    Lines are cut at ``\\n``; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Earlier means a smaller doc_id, or the same
    document and an earlier line; lines are judged on the input, not on what is left. Lines without words stay.
    Returns doc_id, n_lines, n_removed and text (the lines that stay, joined by newlines), a row for each input row.
    Null text is empty. Rows of equal doc_id are judged in the order of their texts (of their blocks first, see ``blocks.with_block``); null doc_ids come last. Other
    columns are not read, but with ``carry`` go along as ``blocks.texts`` says. Sets are told apart by 64-bit hashes of 64-bit word hashes, words within a pair of lines by 36 bits.
    """
    whole_rows = blocks.texts(docs, id_col, text_col, carry)
    docs = whole_rows.select("doc_id", "text")
    _, size = blocks.volume(docs)
    bounds = Filter(Fraction(threshold))
    count = blocks.partition_count(size // 4)  # small partitions: what is sent again is many times a posting
    fewer = max(1, count // 16)  # what is sent again is little, and lines are sent whole to each partition
    tasks = blocks.table_tasks(docs, size)
    words = _counted(docs, tasks, lambda body, offs: _slot(Words(body, offs, lower=True).hashes() & _HASH))
    rarity = np.minimum(255, 8 * np.log2(1 + words)).astype(np.uint8)

    def prefix_slots(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
        tokens, first, whole = Lines(body, offs).sets(rarity)
        _, at = np.unique(set_ids(whole, first), return_index=True)
        chosen = np.zeros(len(first) - 1, bool)
        chosen[at] = True
        return _slot(_prefixes(tokens, first, chosen, bounds)[2])

    load = _counted(docs, tasks, prefix_slots)
    model = docs.sparkSession.sparkContext.broadcast((rarity, load.astype(np.uint32), bounds, cell))
    spread = blocks.crowded(docs, blocks.block_count(size))
    dealt = blocks.with_block(docs, blocks.block_count(size), spread)
    grouped = dealt.groupBy("block")
    sent = grouped.applyInArrow(_post(model, count), "part int, block int, postings binary, shape binary, keys binary, docs binary, lines binary").groupBy("part")
    asked = sent.applyInArrow(_candidates(bounds), "block int, sets binary")
    whole = grouped.cogroup(asked.groupBy("block")).applyInArrow(_post_whole(model, fewer), "part int, block int, postings binary, tokens binary, sizes binary")
    similar = whole.groupBy("part").applyInArrow(_verified(bounds, count), "part int, sets binary")
    answers = sent.cogroup(similar.groupBy("part")).applyInArrow(_judge, "block int, lines binary")  # one exchange of ``sent`` serves both
    result = "doc_id long, n_lines long, n_removed long, text string"
    if carry:
        grouped = blocks.with_block(whole_rows, blocks.block_count(size), spread).groupBy("block")
        result += f", rest {blocks.sql_type(whole_rows, 'rest')}"
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(_cut, result)


def digest(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
