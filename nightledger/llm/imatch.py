"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: rarer terms are noise, commoner ones tell nothing.
A text's main hash is of its sorted distinct lexicon terms. Beside it ``SUBSETS`` hashes are taken of random subsets of
the lexicon at several rates, so that after an edit some of them stay; their agreement is the likeness of two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from . import blocks
from .words import Words, chunks, mix, powers, texts_of

LOW, HIGH = 0.0005, 0.1  # the band, as shares of all documents; a term of one document is never in it
RATES = (32, 128, 512, 2048)  # a term is in one of a rate's 16 subsets with a probability of 16 / rate
PER_RATE = 16
SUBSETS = PER_RATE * len(RATES)
RUN_BYTES = 16 << 20  # text of one run of neighbouring documents
RUNS = 100_000  # runs at most, longer ones beyond 1.6 TB; their bounds are broadcast
_STEP = 0xA0761D6478BD642F


def _distinct(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs, sorted."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _count_documents(count: int):
    """Of how many texts each term is a term, as key lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, texts, pairs = 0, 0, 0
        schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64()), ("pairs", pa.int64())])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]

        def flush(keys, n):
            order, bounds = blocks.slices(blocks.partition_of(keys, count), count)
            own = {p: order[bounds[p] : bounds[p + 1]] for p in range(count) if bounds[p + 1] > bounds[p]}
            return pa.RecordBatch.from_pydict({"part": list(own), "keys": [keys[x].tobytes() for x in own.values()], "counts": [n[x].astype(np.uint32).tobytes() for x in own.values()], "texts": [0] * len(own), "pairs": [0] * len(own)}, schema)

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b, body, offs in chunks(data, offsets):
                words = Words(body, offs, lower=True)
                _, terms = _distinct(words.text(), words.hashes())
                keys, n = np.unique(terms, return_counts=True)
                held.append((keys, n.astype(np.int64)))
                size, texts, pairs = size + len(keys), texts + b - a, pairs + len(terms)
                if size > 3_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield flush(*held[0])
                        held, size = [], 0
        if held:
            yield flush(*merged())
        yield pa.RecordBatch.from_pydict({"part": [-1], "keys": [b""], "counts": [b""], "texts": [texts], "pairs": [pairs]}, schema)

    return run


def _sum_documents(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat(counts, first) if len(first) else counts
    keep = counts >= 2
    total = lambda c: [int(sum(table.column(c).to_pylist()))]
    return pa.table({"part": table.column("part").slice(0, 1).combine_chunks(), "keys": [keys[first][keep].tobytes()], "counts": [counts[keep].tobytes()], "texts": total("texts"), "pairs": total("pairs")})


def _in_band(low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(counts, np.int64)
                out.append(np.frombuffer(keys, np.uint64)[(n >= low) & (n <= high)].tobytes())
            yield pa.RecordBatch.from_pydict({"keys": pa.array(out, pa.binary())})

    return run


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all ``docs`` (doc_id, text).

    Each term of it is in ``low`` of the texts at least, so there are mean distinct terms of a text / low of them at most: 2,000 for each
    distinct term that a text has on average (5 MB of hashes for texts of 300 terms), however many texts there are.
    """
    spark = docs.sparkSession
    _, size = blocks.volume(docs)
    count = blocks.partition_count(size // 12)
    lists = docs.select("text").coalesce(blocks.table_tasks(docs, size)).mapInArrow(_count_documents(count), "part int, keys binary, counts binary, texts long, pairs long")
    counted = durable(lists.groupBy("part").applyInArrow(_sum_documents, "part int, keys binary, counts binary, texts long, pairs long"))
    n = counted.agg(F.sum("texts")).first()
    texts = n[0] or 0
    found = counted.where("part >= 0").select("keys", "counts").mapInArrow(_in_band(max(2, texts * low), max(texts * high, 2)), "keys binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in found)]))


class Fingerprinter:
    """Main hash and subset hashes of texts; a subset without a term has hash 0."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(terms >> np.uint64(42)).astype(np.int64)] = True

    def _kept(self, hashes: np.ndarray) -> np.ndarray:
        keep = self.maybe[(hashes >> np.uint64(42)).astype(np.int64)]
        sure = np.flatnonzero(keep)
        at = np.minimum(np.searchsorted(self.terms, hashes[sure]), max(len(self.terms) - 1, 0))
        keep[sure] = self.terms[at] == hashes[sure] if len(self.terms) else False
        return keep

    @staticmethod
    def _folded(group: np.ndarray, terms: np.ndarray, groups: int) -> np.ndarray:
        """A hash of each group's terms in order; ``group`` is sorted."""
        out = np.zeros(groups, np.uint64)
        if len(group):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))
            out[group[first]] = mix(np.add.reduceat(terms * powers(_STEP, int(rank.max()) + 1)[rank], first) + np.uint64(1))
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(main hashes, subset hashes of 16 bits as a matrix) of some texts."""
        n = len(offsets) - 1
        words = Words(data, offsets, lower=True)
        hashes, text = words.hashes(), words.text()
        keep = self._kept(hashes)
        bare = np.bincount(text[keep], minlength=n) == 0  # a text outside the lexicon is judged by all its terms
        keep |= bare[text]
        text, terms = _distinct(text[keep], hashes[keep])
        main = self._folded(text, terms, n)
        subsets, members = [], []
        for g, rate in enumerate(RATES):
            cell = (mix(terms ^ np.uint64(0x9E3779B97F4A7C15 * (g + 1) % (1 << 64))) >> np.uint64(20)).astype(np.int64) % rate
            inside = np.flatnonzero(cell < PER_RATE)
            members.append(inside)
            subsets.append(text[inside] * SUBSETS + g * PER_RATE + cell[inside])
        members, subsets = np.concatenate(members), np.concatenate(subsets)
        order = np.lexsort((members, subsets))
        small = self._folded(subsets[order], terms[members[order]], n * SUBSETS)
        return main, np.where(small == 0, 0, 1 + (small >> np.uint64(32)) % np.uint64(65535)).astype(np.uint16).reshape(n, SUBSETS)


def likeness(main: np.ndarray, small: np.ndarray, main2: np.ndarray, small2: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets that have a term of either text; 1 for equal main hashes."""
    both = (small != 0) | (small2 != 0)
    same = ((small == small2) & both).sum(axis=1)
    return np.where(main == main2, 1.0, same / np.maximum(both.sum(axis=1), 1))


def shown(main: np.ndarray, small: np.ndarray) -> list[str]:
    return [f"{m:016x}{s.tobytes().hex()}" for m, s in zip(main.tolist(), small.astype(">u2"))]


def _pairs(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(model.value)
        carried: list[tuple] = []
        for batch in batches:
            rows = carried + list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist()))
            carried = rows[-1:]
            at = 0
            while at < len(rows) - 1:
                end, size = at, 0
                while end < len(rows) - 1 and size < (2 << 20):
                    size += len(rows[end][1])
                    end += 1
                yield _edited(rows[at : end + 1], printer)
                at = end

    return run


def _edited(rows: list[tuple], printer: Fingerprinter) -> pa.RecordBatch:
    """Every row but the last against the row after it."""
    texts = [r[1] for r in rows]
    own = [k for k in range(len(rows) - 1) if not rows[k][2]]
    edited = []
    for k in own:
        half = len(texts[k]) // 2
        edited.append((texts[k][: len(texts[k]) - half] + texts[k + 1][:half]).encode())
    raw = [t.encode() for t in texts] + edited
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    main, small = printer.of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    own, n = np.array(own, np.int64), len(texts)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = [
        pa.array([rows[k][0] for k in own], pa.int64()),
        pa.array([len(texts[k]) for k in own], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(shown(main[own], small[own]), pa.string()),
        pa.array(shown(main[n:], small[n:]), pa.string()),
        pa.array(likeness(main[own], small[own], main[n:], small[n:]), pa.float64()),
        pa.array(likeness(main[own], small[own], main[own + 1], small[own + 1]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like the edited text and the next document are.

    The next document is that of the next smaller doc_id (after the last, the first); the edited text has the last
    floor(n_chars / 2) code points replaced by the first as many of the next. Null text is empty; equal doc_ids follow one
    another by text, null doc_ids come last. A text without lexicon terms is judged by all its terms, an empty one has a
    fixed fingerprint. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (272 hex digits: the main
    hash, then 64 subsets), near_edited and near_next (0 to 1). Other columns are not read.

    Documents are dealt into runs of neighbouring doc_ids; the first document of a run is copied to the end of the run before.
    """
    spark = docs.sparkSession
    docs = blocks.texts(docs)
    model = spark.sparkContext.broadcast(lexicon(docs, low, high))
    _, size = blocks.volume(docs)
    lowest = -(1 << 63)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(lowest))).withColumn("at", F.col("key").cast("double"))
    runs = min(RUNS, max(1, size // RUN_BYTES))
    cuts = sorted(set(keyed.approxQuantile("at", [k / runs for k in range(1, runs)], 0.1 / runs))) if runs > 1 else []
    if cuts:
        keyed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="place").transform(keyed).withColumn("run", F.col("place").cast("int")).drop("place")
    else:
        keyed = keyed.withColumn("run", F.lit(0))
    tops = keyed.groupBy("run").agg(F.max("key").alias("top")).orderBy("run").collect()  # RUNS rows at most
    order = [r["run"] for r in tops]
    before = {run: order[(k + 1) % len(order)] for k, run in enumerate(order)}  # the sequence runs downwards
    bounds = spark.createDataFrame([(r["run"], r["top"], before[r["run"]]) for r in tops], "run int, top long, before int")
    copies = F.array(F.struct("run", F.lit(False).alias("tail")), F.struct(F.col("before").alias("run"), F.lit(True).alias("tail")))
    ends = keyed.join(F.broadcast(bounds), "run").withColumn("to", F.explode(F.when(F.col("key") == F.col("top"), copies).otherwise(F.slice(copies, 1, 1))))
    dealt = ends.select("to.run", "to.tail", "key", "doc_id", "text").repartition("run").sortWithinPartitions("run", "tail", F.desc("key"), "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(_pairs(model), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
