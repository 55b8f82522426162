"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is compressed piece by piece once with each dictionary. The difference of the two sizes, as a share of their
sum, says which kind of text it is nearer to; a logistic curve, fitted on labelled rows that built no dictionary, makes
that a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from . import blocks

DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 2 << 10  # a text's pieces are compressed one by one, so that a long text can't make up for the dictionary
SAMPLE_ROWS = 1500  # labelled rows of each class for the dictionaries, and as many again for the curve
TRAIN_BYTES = 16 << 20  # text of each class for its dictionary: whole texts, in the order of the hash, as many as fit
LEVEL = 3


def learns(column: str = "doc_id", modulus: int = 3, residue: int = 1):
    """True for rows whose label may be learnt; a null id's may not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus != residue, F.lit(False))


def pieces(text: bytes) -> list[bytes]:
    return [text[a : a + PIECE_BYTES] for a in range(0, len(text), PIECE_BYTES)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on all pieces of the texts; of too little text, the text itself."""
    samples = [piece for text in texts for piece in pieces(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fitting(sizes: list[int], budget: int) -> list[int]:
    """Which texts, taken in order, go into a budget of bytes: one that doesn't fit any more is left out whole, and a shorter one after it may still fit."""
    chosen, left = [], budget
    for k, size in enumerate(sizes):
        if size <= left:
            chosen.append(k)
            left -= size
    return chosen


def dictionaries(docs: DataFrame, sample: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[bytes, bytes]:
    """The dictionaries of good and of bad text, from the documents of ``sample`` (doc_id, quality, h; a bounded number of rows).

    Texts go in whole, in the order of h, as many of each class as fit into ``train_bytes``; the driver sees their sizes first and then only the texts that fit.
    Of a doc_id with several texts the least is taken.
    """
    built = docs.where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text"))
    built = durable(built)  # as many rows as the sample at most
    sizes = sorted(built.select("quality", "h", "doc_id", F.octet_length("text").alias("n")).collect())
    kept = []
    for quality in (1, 0):
        own = [r for r in sizes if r["quality"] == quality]
        kept += [(own[k]["doc_id"],) for k in fitting([r["n"] for r in own], train_bytes)]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long"))
    rows = sorted(built.join(chosen, "doc_id").select("quality", "h", "doc_id", "text").collect())
    good, bad = ([r["text"].encode() for r in rows if r["quality"] == q] for q in (1, 0))
    return _dictionary(good), _dictionary(bad)


def features(model):
    """(size difference as a share of the sum, sum) of a text: the difference is positive where the good dictionary does better."""
    kinds = []
    for raw in model:
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
        if data is not None:
            data.precompute_compress(level=LEVEL)
        kinds.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(text: bytes) -> tuple[float, int]:
        good = bad = 0
        for piece in pieces(text):
            good += len(kinds[0].compress(piece))
            bad += len(kinds[1].compress(piece))
        return ((bad - good) / (bad + good) if text else 0.0), bad + good

    return of


def _measure(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(model.value)
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            found = [(*of(raw), len(raw)) for raw in text.to_pylist()]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            own = {c: batch.column(c) for c in (("doc_id", "text", "rest") if "rest" in batch.schema.names else ("doc_id",))}
            yield pa.RecordBatch.from_arrays([*own.values(), *columns], [*own, "difference", "compressed", "n_bytes"])
        blocks.release()

    return run


MEASURED = "difference double, compressed long, n_bytes long"


def inputs(difference, compressed, n_bytes) -> list:
    """What the curve is fitted on, as columns: the difference, the same growing with the evidence, how far the text
    shrinks at all (a text of repeats shrinks alike with either dictionary) and its length."""
    shrink = F.log2((compressed + 2) / (2 * (n_bytes + 1)))
    return [F.lit(1.0), 100 * difference, 100 * difference * F.log2(1 + n_bytes / 256), F.least(shrink, F.lit(0.0)), F.log2(1 + n_bytes / 256)]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, gradient)
    return beta


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: bool = False, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, score (probability that quality is 1) and predicted (1 if score >= 0.5, else 0) of every row of ``docs``.

    Learns from the rows of ``labels`` (doc_id, quality) whose crc32(doc_id) mod 3 is not 1, quality 0 or 1 (others and
    nulls are left out), one of each repeated doc_id. Of each class the ``2 * sample_rows`` smallest hashes of doc_id are used:
    half build the dictionary (see ``dictionaries``), half fit the curve, weighted to the class shares of all learning rows.
    Only text is an input of the score. Null and empty texts get the score of no difference; rows repeat as they come.
    With ``carry`` the rows keep text and rest, see ``blocks.texts``. With labels of one class, or none, every text gets that class's share, smoothed.
    """
    spark = docs.sparkSession
    whole_rows = blocks.texts(docs, carry=carry)
    docs = whole_rows.select("doc_id", "text")
    known = labels.where(learns()).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 1) / (total + 2)
    beta, model = np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0, 0.0]), (b"", b"")
    if len(shares) == 2:
        chosen = [known.where(F.col("quality") == q).orderBy("h", "doc_id").limit(2 * sample_rows).withColumn("builds", F.pmod(F.col("h").bitwiseXOR(F.shiftright("h", 20)), F.lit(2)) == 0) for q in (0, 1)]
        sample = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id"), "quality", "builds", "h"))  # 4 * sample_rows at most
        model = dictionaries(docs, sample.where("builds"), train_bytes)
        known_model = spark.sparkContext.broadcast(model)
        fitted = docs.join(sample.where("not builds"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        measured = fitted.mapInArrow(_measure(known_model), f"doc_id long, {MEASURED}").join(sample, "doc_id")
        measured = measured.select("doc_id", "quality", F.array(*inputs(*map(F.col, ("difference", "compressed", "n_bytes")))).alias("x")).collect()
        measured.sort(key=lambda r: (r["doc_id"], r["x"]))
        y = np.array([r["quality"] for r in measured], float)
        if len(set(y)) == 2:
            n = {q: (y == q).sum() for q in (0, 1)}
            weight = np.where(y == 1, shares[1] / total / n[1], shares[0] / total / n[0]) * len(y)
            beta = _fit(np.array([r["x"] for r in measured]), y, weight)
    final = spark.sparkContext.broadcast(model)
    extra = f"text string, rest {blocks.sql_type(whole_rows, 'rest')}, " if carry else ""
    found = whole_rows.mapInArrow(_measure(final), f"doc_id long, {extra}{MEASURED}")
    odds = sum((w * x for w, x in zip(beta.tolist(), inputs(*map(F.col, ("difference", "compressed", "n_bytes"))))), F.lit(0.0))
    scored = found.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference", *(("text", "rest") if carry else ()))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1's contract."""
    found = classify(docs, labels)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
