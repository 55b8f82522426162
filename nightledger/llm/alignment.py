"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut a text's bytes in two ways. Between two neighbouring ends, of either, lies one piece of one token of each, so such pieces are the links:
the pairs of token occurrences that overlap. Documents are dealt into segments of some MB; a segment keeps, for each pair of ids, a compressed bitmap
of its documents that hold the pair linked (the chunks' bitmaps OR-ed together: gaps between document numbers, or plain bits where a pair is in an eighth of the documents) and
planes of such bitmaps, one for each binary digit of how often beyond once. Popcounts give a segment's document and link counts of a pair; segments share no
document, so their sums are those of the OR over all. The counts go back to each segment, whose postings turn them into scores of documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from . import blocks
from .pieces import BPE, MARK, MODEL, NORMAL, Codec, parse_model
from .words import chunks, mix, texts_of

BYTE_BPE = MODEL.rsplit("/", 1)[0] + "/byte_bpe_50k.json"
SEGMENT_BYTES, SEGMENT_DOCS = 6 << 20, 16_383  # gaps of document numbers take two bytes at most
KEYS_A_PARTITION = 4 << 20
DENSE = 8  # a bitmap is plain bits from one document in so many
# How byte-level vocabularies cut texts before they merge bytes, and which bytes they write as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = 6  # a SentencePiece byte piece


class Side:
    """A tokenizer: ``run`` gives ids, ``size[i]`` the bytes of id i, ``vocabulary`` how many ids there are.

    ``order`` lists the byte strings of the merging ranks, ``ids`` what each stands for; a text with one of ``barred`` has no tokens.
    """

    def __init__(self, order: list[bytes], ids: list[list[int]], pattern: str, vocabulary: int, barred: str | None = None):
        self.encoding = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks={b: k for k, b in enumerate(order)}, special_tokens={})
        self.vocabulary, self.barred = vocabulary, barred
        self.length = np.array([len(x) for x in ids], np.int64)
        self.flat = np.array([i for x in ids for i in x], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.single = bool((self.length == 1).all())
        self.size = np.zeros(vocabulary, np.int64)
        for b, own in zip(order, ids):
            if len(own) == 1:
                self.size[own[0]] = len(b)

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each)."""
        ranks = [self.encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
        flat = np.concatenate([np.zeros(0, np.uint32), *ranks]).astype(np.int64)
        counts = np.fromiter(map(len, ranks), np.int64, len(ranks))
        if self.single:
            return self.flat[flat], counts
        n = self.length[flat]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.at[flat] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(edges)


def byte_level(data: bytes) -> Side:
    """A byte-level BPE of the tokenizers library's JSON, whose merges are in the order of their ids. Names of special tokens are plain text."""
    model = json.loads(data)["model"]
    names = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in PLAIN_BYTES)}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("the merges of this vocabulary are not in the order of its ids")
    tokens = sorted((i, bytes(names[c] for c in t)) for t, i in vocabulary.items() if all(c in names for c in t))
    return Side([b for _, b in tokens], [[i] for i, _ in tokens], SPLIT, max(vocabulary.values()) + 1)


def pieces_side(data: bytes) -> Side:
    """A SentencePiece BPE with byte fallback, as ranks of byte strings.

    Characters come before all other merges, and so do the beginnings of characters of three and four bytes, which fall apart into byte pieces where no character comes of them. No piece
    may hold a mark after another character, so that runs of marks cut the text, and each piece must be what its own text encodes to. The mark itself in a text would become a space, so such
    texts are barred.
    """
    model = parse_model(data)
    pieces = [(p.replace(MARK, " ").encode(), i, s) for i, (p, s, kind) in enumerate(model.pieces) if kind == NORMAL]
    kinds = {kind for _, _, kind in model.pieces}
    plain = model.kind == BPE and model.byte_fallback and model.dummy_prefix and model.escape_spaces and not model.charsmap and not model.strip_extra_spaces
    if not plain or any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces) or not kinds <= {NORMAL, 2, 3, BYTE}:
        raise ValueError("only plain BPE models with byte fallback are read here")
    words = Codec(data).words
    own = words.encode_batch_fast([model.pieces[i][0] for _, i, _ in pieces], add_special_tokens=False)
    if any(e.ids != [i] for e, (_, i, _) in zip(own, pieces)):
        raise ValueError("a piece of this model is not what its own text encodes to")
    singles = [(b, i) for b, i, _ in pieces if len(b) > 1 and len(b.decode()) == 1]
    begun = sorted({b[:n] for b, _ in singles for n in range(2, len(b))}, key=lambda b: (len(b), b))
    longer = [b for b, _, s in sorted(pieces, key=lambda x: (-x[2], x[1])) if len(b.decode()) > 1]
    order = [bytes([b]) for b in range(256)] + begun + [b for b, _ in singles] + longer
    known = {b: i for b, i, _ in pieces}
    of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
    side = Side(order, [[known[b]] if b in known else [of_byte[x] for x in b] for b in order], r" +[^ ]*|[^ ]+", len(model.pieces), MARK)
    side.size[list(of_byte.values())] = 1
    return side


def _varints(gaps: np.ndarray) -> bytes:
    wide = gaps >= 128
    at = np.cumsum(wide + 1) - wide - 1
    out = np.zeros(len(gaps) + int(wide.sum()), np.uint8)
    out[at] = (gaps & 127) | (wide << 7)
    out[at[wide] + 1] = gaps[wide] >> 7
    return out.tobytes()


def _of_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    follows = np.zeros(len(raw) + 1, bool)
    follows[1:] = raw >= 128  # a second byte is below 128
    at = np.flatnonzero(~follows[:-1])
    out = raw[at] & 127
    wide = follows[at + 1]
    out[wide] |= raw[at[wide] + 1] << 7
    return out


def pack(row: np.ndarray, doc: np.ndarray, rows: int, docs: int) -> tuple[np.ndarray, bytes, bytes]:
    """(popcounts, gaps, bits): the bitmaps of ``rows`` pairs over ``docs`` documents from set bits in order of (row, doc)."""
    counts = np.bincount(row, minlength=rows)
    dense = counts * DENSE >= docs
    loose = ~dense[row]
    own, d = row[loose], doc[loose]
    gaps = d + 1
    if len(d):
        same = own[1:] == own[:-1]
        gaps[1:][same] = d[1:][same] - d[:-1][same]
    place = np.cumsum(dense) - 1
    bits = np.zeros((int(dense.sum()), docs), bool)
    bits[place[row[~loose]], doc[~loose]] = True
    return counts.astype(np.uint16), _varints(gaps), np.packbits(bits, axis=1).tobytes()


def unpack(counts: np.ndarray, gaps: bytes, bits: bytes, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The set bits (row, doc) of ``pack``, those of plain bits last."""
    counts = counts.astype(np.int64)
    dense = counts * DENSE >= docs
    loose = np.flatnonzero(~dense)
    row = np.repeat(loose, counts[loose])
    sums = np.concatenate([[0], np.cumsum(_of_varints(gaps))])
    first = np.cumsum(counts[loose]) - counts[loose]
    doc = sums[1:] - np.repeat(sums[first], counts[loose]) - 1
    wide = -(-docs // 8)
    full = np.flatnonzero(dense)
    plain = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(full), wide), axis=1, count=docs) if len(full) else np.zeros((0, docs), np.uint8)
    r, d = np.nonzero(plain)
    return np.concatenate([row, full[r]]), np.concatenate([doc, d])


class Aligned:
    """The alignment of a chunk of texts; ``doc`` are the texts that have tokens, everything else is theirs one after the other."""

    def __init__(self, a: Side, b: Side, texts: list[str | None]):
        self.doc = np.array([i for i, t in enumerate(texts) if t and not any(s.barred and s.barred in t for s in (a, b))], np.int64)
        spaced = [" " + texts[i] for i in self.doc.tolist()]
        (self.a, self.n_a), (self.b, self.n_b) = a.run(spaced), b.run(spaced)
        ends_a, ends_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        marks = np.zeros(total + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        at = np.flatnonzero(marks)  # a link ends at each
        of_a, of_b = (marks[at] & 1).astype(np.int64), (marks[at] >> 1).astype(np.int64)
        self.link_a, self.link_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        shared = of_a & of_b
        group = np.cumsum(shared) - shared
        self.group_a, self.group_b, self.groups = group[of_a == 1], group[of_b == 1], int(shared.sum())
        self.last_a, self.last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        ends = np.concatenate([[0], np.searchsorted(at, ends_a[self.last_a - 1], "right")]) if len(self.doc) else np.zeros(1, np.int64)
        self.n_links = np.diff(ends)
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(shared)])[ends])

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text with tokens: ids in decimals, groups apart by semicolons."""
        in_a, in_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        n = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends = np.cumsum(in_a + in_b)
        sign[ends - 1] = ord(";")
        sign[ends - in_b - 1] = ord("|")
        size = 2 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000) + (ids >= 100_000)  # with the sign
        upto = np.cumsum(size)
        out = np.empty(int(upto[-1]) if n else 0, np.uint8)
        out[upto - 1] = sign
        rest = ids.copy()
        for k in range(2, 8):
            has = np.flatnonzero(size >= k)
            out[upto[has] - k] = 48 + rest[has] % 10
            rest //= 10
        cuts = np.concatenate([[0], upto[self.last_a + self.last_b - 1]]) if len(self.doc) else np.zeros(1, np.int64)
        raw = out.tobytes()
        return [raw[s : e - 1] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_SIDES: dict[tuple[bytes, bytes], tuple[Side, Side]] = {}


def _of_worker(a: bytes, b: bytes) -> tuple[Side, Side]:
    key = (hashlib.sha256(a).digest(), hashlib.sha256(b).digest())
    if key not in _SIDES:
        _SIDES.clear()
        _SIDES[key] = byte_level(a), pieces_side(b)
    return _SIDES[key]


def _pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    column = batch.column("text")
    data, offsets = texts_of(column)
    ids = batch.column("doc_id")
    for a, b, _, _ in chunks(data, offsets):
        yield ids.slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist()


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_INDEX = "seg long, n_docs int, n_pairs long, keys binary, counts binary, gaps binary, bits binary, planes array<binary>, doc_id array<long>, local array<int>, " + ", ".join(f"{c} array<int>" for c in _NUMBERS) + ", groups_sha256 array<string>"


class _Segment:
    """Documents of one segment: their numbers, and the set bits of its bitmaps as key << 14 | document with how often."""

    def __init__(self, number: int):
        self.number, self.bytes, self.docs = number, 0, 0
        self.columns: dict[str, list] = {c: [] for c in ("doc_id", "local", *_NUMBERS, "groups_sha256")}
        self.bits: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list, found: Aligned, b_size: int, size: int) -> None:
        n, has = len(ids), found.doc
        own = {c: np.zeros(n, np.int64) for c in _NUMBERS}
        for c in _NUMBERS:
            own[c][has] = getattr(found, c)
            self.columns[c] += own[c].tolist()
        sha, local = [""] * n, np.full(n, -1, np.int64)
        for i, text in zip(has.tolist(), found.written()):
            sha[i] = hashlib.sha256(text).hexdigest()
        local[has] = self.docs + np.arange(len(has))
        self.columns["doc_id"] += ids
        self.columns["local"] += local.tolist()
        self.columns["groups_sha256"] += sha
        pair = found.a[found.link_a] * b_size + found.b[found.link_b]
        doc = self.docs + np.repeat(np.arange(len(has)), found.n_links)
        bits, times = np.unique(pair << 14 | doc, return_counts=True)
        self.bits.append(bits)
        self.times.append(times)
        self.docs += len(has)
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        bits, times = np.concatenate([np.zeros(0, np.int64), *self.bits]), np.concatenate([np.zeros(0, np.int64), *self.times])
        order = np.argsort(bits, kind="stable")
        bits, more = bits[order], times[order] - 1
        keys, row = np.unique(bits >> 14, return_inverse=True)
        doc = bits & 16_383
        counts, gaps, plain = pack(row, doc, len(keys), self.docs)
        planes: list[bytes] = []
        while more.any():
            on = (more & 1) == 1
            which, own = np.unique(row[on], return_inverse=True)
            n, g, p = pack(own, doc[on], len(which), self.docs)
            planes += [which.astype(np.uint32).tobytes(), n.tobytes(), g, p]
            more >>= 1
        values = {"seg": self.number, "n_docs": self.docs, "n_pairs": len(keys), "keys": keys.tobytes(), "counts": counts.tobytes(), "gaps": gaps, "bits": plain, "planes": planes} | self.columns
        types = {"seg": pa.int64(), "n_docs": pa.int32(), "n_pairs": pa.int64(), "planes": pa.list_(pa.binary()), "doc_id": pa.list_(pa.int64()), "groups_sha256": pa.list_(pa.string())} | {c: pa.list_(pa.int32()) for c in ("local", *_NUMBERS)}
        return pa.RecordBatch.from_arrays([pa.array([v], types.get(c, pa.binary())) for c, v in values.items()], list(values))


def _index(a_data, b_data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _of_worker(a_data.value, b_data.value)
        number = TaskContext.get().partitionId() << 32
        segment = _Segment(number)
        for batch in batches:
            for ids, texts in _pieces_of(batch):
                for at in range(0, len(ids), 4096):
                    own = texts[at : at + 4096]
                    if segment.columns["doc_id"] and (segment.bytes >= SEGMENT_BYTES or len(segment.columns["doc_id"]) + len(own) > SEGMENT_DOCS):
                        yield segment.row()
                        number += 1
                        segment = _Segment(number)
                    segment.add(ids[at : at + 4096], Aligned(a, b, own), b.vocabulary, sum(map(len, own)))
        if segment.columns["doc_id"]:
            yield segment.row()
        blocks.release()

    return run


def links(row: dict, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document counts, link counts) of an index row, by popcounts of its bitmaps and planes."""
    keys, counts = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["counts"], np.uint16).astype(np.int64)
    total = counts.copy()
    for j in range(len(row["planes"]) // 4):
        total[np.frombuffer(row["planes"][4 * j], np.uint32)] += np.frombuffer(row["planes"][4 * j + 1], np.uint16).astype(np.int64) << j
    return keys, counts, total


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return blocks.partition_of(mix(keys.astype(np.uint64)), parts)


def _popcounts(parts: int, b_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                keys, docs, total = links(row, b_size)
                order, bounds = blocks.slices(_part_of(keys, parts), parts)
                own = [order[bounds[p] : bounds[p + 1]] for p in range(parts)]
                found = [p for p in range(parts) if len(own[p])]
                columns = [pa.array(found, pa.int32()), pa.array([row["seg"]] * len(found), pa.int64())]
                columns += [pa.array([x[own[p]].tobytes() for p in found], pa.binary()) for x in (keys, docs.astype(np.uint16), total.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seg", "keys", "docs", "links"])
        blocks.release()

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys, document counts, link counts, place of each list's keys, length of each list)."""
    lists = table.column("keys").to_pylist()
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in lists])
    docs = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("docs").to_pylist()])
    total = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("links").to_pylist()])
    distinct, place = np.unique(keys, return_inverse=True)
    add = lambda x: np.bincount(place, weights=x, minlength=len(distinct)).astype(np.int64)  # noqa: E731  exact below 2**53
    return distinct, add(docs), add(total), place, [len(x) // 8 for x in lists]


def _answers(b_size: int):
    def run(table: pa.Table) -> pa.Table:
        """A row for each list with its pairs' document counts over all segments, and one with the highest of each A id here."""
        distinct, docs, _, place, sizes = _summed(table)
        of_a = distinct // b_size
        first = np.flatnonzero(np.concatenate([[True], of_a[1:] != of_a[:-1]]))
        counts, at = docs[place].astype(np.int64), np.cumsum([0, *sizes])
        seg = table.column("seg").to_pylist()
        rows = {
            "seg": [*seg, None], "part": table.column("part").to_pylist() + [table.column("part")[0].as_py()], "counts": [counts[s:e].tobytes() for s, e in zip(at[:-1], at[1:])] + [None],
            "best_a": [None] * len(seg) + [of_a[first].tolist()], "best_n": [None] * len(seg) + [np.maximum.reduceat(docs, first).tolist()],
        }
        return pa.table(rows, schema=pa.schema([("seg", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("best_a", pa.list_(pa.int64())), ("best_n", pa.list_(pa.int64()))]))

    return run


def _scored(parts: int, b_size: int, best):
    def run(index: pa.Table, answers: pa.Table) -> pa.Table:
        highest = best.value
        out = []
        told = {p: c for p, c in zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist())}
        for row in index.to_pylist():  # one
            keys, docs = np.frombuffer(row["keys"], np.int64), row["n_docs"]
            order, bounds = blocks.slices(_part_of(keys, parts), parts)
            count = np.zeros(len(keys), np.int64)
            for p, data in told.items():
                count[order[bounds[p] : bounds[p + 1]]] = np.frombuffer(data, np.int64)
            is_best = count == highest[keys // b_size]
            sums, bests = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            layers = [(None, row["counts"], row["gaps"], row["bits"], 1)]
            layers += [(*row["planes"][4 * j : 4 * j + 4], 1 << j) for j in range(len(row["planes"]) // 4)]
            for which, counts, gaps, bits, times in layers:
                pair, doc = unpack(np.frombuffer(counts, np.uint16), gaps, bits, docs)
                pair = pair if which is None else np.frombuffer(which, np.uint32)[pair]
                sums += times * np.bincount(doc, weights=count[pair], minlength=docs).astype(np.int64)
                bests += times * np.bincount(doc[is_best[pair]], minlength=docs)
            local = np.array(row["local"], np.int64)
            spread = lambda x: np.where(local >= 0, np.concatenate([x, [0]])[local], 0)
            columns = [pa.array(row["doc_id"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in _NUMBERS), pa.array(spread(bests)), pa.array(spread(sums)), pa.array(row["groups_sha256"], pa.string())]
            out.append(pa.table(columns, names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")})

    return run


class PairIndex:
    """Segments of documents with their pair bitmaps, written once to the checkpoint folder."""

    def __init__(self, docs: DataFrame, a_file: str = BYTE_BPE, b_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        a, b = (self.spark.sparkContext.broadcast(open(f, "rb").read()) for f in (a_file, b_file))
        self.b_size = len(parse_model(b.value).pieces)
        self.segments = stored(blocks.texts(docs, id_col, text_col).mapInArrow(_index(a, b), _INDEX))
        pairs = self.segments.agg(F.sum("n_pairs")).first()[0] or 0  # one number
        self.parts = max(1, -(-pairs // KEYS_A_PARTITION))
        self.popcounts = self.segments.select("seg", "keys", "counts", "planes").mapInArrow(_popcounts(self.parts, self.b_size), "part int, seg long, keys binary, docs binary, links binary")

    def pair_counts(self) -> DataFrame:
        """a, b, n_documents, n_links: in how many documents each linked pair of ids is, and how many links it has."""

        def run(table: pa.Table) -> pa.Table:
            keys, docs, total, _, _ = _summed(table)
            return pa.table({"a": keys // b_size, "b": keys % b_size, "n_documents": docs, "n_links": total})

        b_size = self.b_size
        return self.popcounts.groupBy("part").applyInArrow(run, "a long, b long, n_documents long, n_links long")

    def scores(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
        answers = stored(self.popcounts.groupBy("part").applyInArrow(_answers(self.b_size), "seg long, part int, counts binary, best_a array<long>, best_n array<long>"))
        tops = answers.where("seg is null").select(F.explode(F.arrays_zip("best_a", "best_n")).alias("x")).groupBy("x.best_a").agg(F.max("x.best_n").alias("n")).collect()  # a row for each A id at most
        highest = np.zeros(max([r["best_a"] for r in tops], default=-1) + 1, np.int64)
        for r in tops:
            highest[r["best_a"]] = r["n"]
        best = self.spark.sparkContext.broadcast(highest)
        schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*_NUMBERS, "n_best", "count_sum")) + ", groups_sha256 string"
        asked = answers.where("seg is not null").select("seg", "part", "counts")
        return self.segments.groupBy("seg").cogroup(asked.groupBy("seg")).applyInArrow(_scored(self.parts, self.b_size, best), schema)


def align(docs: DataFrame, a_file: str = BYTE_BPE, b_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row.

    A's tokens are of a space and the text, B adds the space itself; a group lies between neighbouring byte offsets where tokens of both end, a link is a pair of overlapping tokens.
    A pair's count is the number of rows of the table that hold it linked; n_best counts the links whose pair has the highest count of its A id, count_sum adds the counts of all links.

    Null and empty texts, and texts that hold B's mark for a space (so their tokens' bytes would differ from the text), have no tokens: zeros and an empty hash. Repeated rows are documents of
    their own, null ids are kept, an empty table gives an empty result, other columns are not read. The vocabulary files are read on the driver and broadcast; their sizes are fixed. So is the
    table of highest counts (a number for each A id), the only thing that is collected. A text is handled whole, with some 60 bytes for each of its bytes.
    """
    return PairIndex(docs, a_file, b_file, id_col, text_col).scores()


def groups(docs: DataFrame, a_file: str = BYTE_BPE, b_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups: the ids of both tokenizers, group by group, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    spark = docs.sparkSession
    a_data, b_data = (spark.sparkContext.broadcast(open(f, "rb").read()) for f in (a_file, b_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _of_worker(a_data.value, b_data.value)
        for batch in batches:
            for ids, texts in _pieces_of(batch):
                found, out = Aligned(a, b, texts), [""] * len(ids)
                for i, text in zip(found.doc.tolist(), found.written()):
                    out[i] = text.decode()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "groups"])

    return blocks.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups string")


def digest(docs: DataFrame) -> DataFrame:
    """op13's contract."""
    return align(docs)
