"""Periodic runs of words, by string synchronising sets at dyadic scales.

At the scale t a set of positions is chosen by hashes of windows of t words: a position is in it if the least hash of the windows
that start at it and up to t words later is the first or the last of them. Whether it is depends on the next 2t words alone, so a
stretch of period q has the same choice q words on, and every stretch of 3t - 1 words holds a chosen position in its first t unless its
windows are highly periodic (period t/4 at most); those take no part in the minimum. Two consecutive chosen positions of equal context (2t words)
that are q words apart, t <= q < 2t, propose the period q, which is then extended both ways by the hashes of windows of 2^k words. The highly periodic
regions are runs of smaller scales; periods below ``DIRECT`` come from the words compared with themselves some words on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import Words, chunks, mix, string_column, texts_of

DIRECT = 4  # periods below it are found without sets; a power of two
LEAST, TIMES = 6, 4  # a run has LEAST words and TIMES periods at least; the scales rest on TIMES being 4
_ODD = np.uint64(0x9E6C63D0876A9A47)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_NO_RUNS = (np.zeros(0, np.int64),) * 3


def window_hashes(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of every 2**k consecutive words for each 2**k up to ``longest``."""
    out = [words]
    while 2 << (len(out) - 1) <= longest:
        half, last = 1 << (len(out) - 1), out[-1]
        out.append(mix(last[:-half] * _ODD + mix(last[half:])))
    return out


def _agree(hashes: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on are those from j on (i < j); with ``back``, how many before i are those before j."""
    i, j, total, n = i.copy(), j.copy(), np.zeros(len(i), np.int64), len(hashes[0])
    for k in reversed(range(len(hashes))):
        step = 1 << k
        ok = np.flatnonzero(i >= step if back else j + step <= n)
        a, b = (i[ok] - step, j[ok] - step) if back else (i[ok], j[ok])
        ok = ok[hashes[k][a] == hashes[k][b]]
        total[ok] += step
        i[ok] += -step if back else step
        j[ok] += -step if back else step
    return total


def _stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of period q with ``TIMES`` periods at least."""
    same = np.zeros(max(len(words) - q, 0) + 2, np.int8)
    same[1:-1] = words[:-q] == words[q:] if len(words) > q else 0
    turns = np.diff(same)
    start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) + q
    long = end - start >= TIMES * q
    return start[long], end[long]


def synchronising(hashes: list[np.ndarray], k: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The chosen positions of the scale 2**k; start, end and period are the runs of smaller scales."""
    t, own = 1 << k, hashes[k]
    calm = (period * 4 <= t) & (end - start >= t)
    edge = np.zeros(len(own) + 1, np.int64)
    np.add.at(edge, start[calm], 1)
    np.add.at(edge, end[calm] - t + 1, -1)
    masked = np.where(np.cumsum(edge[:-1]) > 0, _MOST, own)
    least, width = masked, 1
    while width < t:  # the minimum of t windows, by doubling
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if len(masked) <= t:
        return np.zeros(0, np.int64)
    least = np.minimum(least[:-1], masked[t:])  # and of t + 1
    return np.flatnonzero((least != _MOST) & ((masked[:-t] == least) | (masked[t:] == least)))


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run of ``TIMES`` periods at least, by start and period.

    ``words`` are hashes of words, texts one after the other with a value of its own between them; ``longest`` is the number of words of the longest text.
    """
    if longest < TIMES:
        return _NO_RUNS
    hashes = window_hashes(words, longest)
    starts, ends, periods = [], [], []

    def add(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> None:
        starts.append(s), ends.append(e), periods.append(q)

    for q in range(1, DIRECT):
        s, e = _stretches(words, q)
        add(s, e, np.full(len(s), q, np.int64))
    k = DIRECT.bit_length() - 1
    while TIMES << k <= longest:
        t = 1 << k
        at = synchronising(hashes, k, *(np.concatenate(x) for x in (starts, ends, periods)))
        context = hashes[k + 1][at]
        order = np.argsort(context, kind="stable")
        i, j = at[order][:-1], at[order][1:]
        proposed = np.flatnonzero((context[order][:-1] == context[order][1:]) & (j - i >= t) & (j - i < 2 * t))
        i, j = i[proposed], j[proposed]
        if len(i):
            q = j - i
            start, end = i - _agree(hashes, i, j, True), j + _agree(hashes, i, j, False)
            long = end - start >= TIMES * q
            add(start[long], end[long], q[long])
        k += 1
    start, end, period = (np.concatenate(x) for x in (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)  # a multiple of the smallest period has the same run
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        for a, b, body, offs in chunks(data, offsets):
            words = Words(body, offs)
            counts, n = words.counts(), len(words.start)
            text = words.text()
            apart = np.empty(n + len(counts), np.uint64)  # each text's words, then a value of its own
            apart[np.arange(n) + text] = words.hashes()
            apart[words.first[1:] + np.arange(len(counts))] = mix(np.arange(len(counts), dtype=np.uint64) + np.uint64(0x51ED270B000000))
            start, end, period = find_runs(apart, int(counts.max(initial=0)))
            long = end - start >= LEAST
            start, end, period = start[long], end[long], period[long]
            own = np.searchsorted(words.first[1:] + np.arange(len(counts)), start, "right")  # the text of each run
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start + period - own, 1)
            np.add.at(edge, end - own, -1)
            stay = np.cumsum(edge[:-1]) == 0
            raw, kept = body.tobytes(), []
            for i in range(len(counts)):
                mine = np.flatnonzero(stay[words.first[i] : words.first[i + 1]]) + words.first[i]
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[mine].tolist(), words.end[mine].tolist())]))
            values = pa.StructArray.from_arrays([pa.array(start - own - words.first[own]), pa.array(end - start), pa.array(period)], fields=list(kind))
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(counts)))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), runs, string_column(kept)], ["doc_id", "n_words", "runs", "collapsed"])
    blocks.release()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed (the text without repetitions), a row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q and a length of max(6, 4 q) at least that no neighbouring word
    extends with period q. ``collapsed`` has the words that no run holds after its first q words, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids are kept, an empty table gives an empty
    result, and other columns are not read. A text is handled whole, in one task, whatever its length: one of n words takes about 8 n log2 n bytes.
    Words are compared by 64-bit hashes.
    """
    return blocks.texts(docs, id_col, text_col).mapInArrow(_runs, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        h = [zlib.crc32(str(i).encode()) if i is not None else 1 for i in ids]
        chosen = np.flatnonzero(np.array([x % 10 == 0 for x in h], bool))
        if not len(chosen):
            yield batch
            continue
        column = batch.column("text")
        changed: dict[int, bytes] = {}
        for i in chosen.tolist():
            words, g = column[i].as_py().encode().split(), h[i] // 10  # bytes: the six ASCII spaces only
            n = len(words)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                changed[i] = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
        texts = [changed[i].decode() if i in changed else column[i].as_py() for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where op12's contract makes the words of a tenth of the documents (by crc32 of the id; not of null ids) repeat from some word on."""
    return blocks.texts(docs, id_col, text_col).mapInArrow(_edited, "doc_id long, text string")


def _lines(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def digest(docs: DataFrame) -> DataFrame:
    """op12's contract; the best run is the longest, then the first, then the one of the smallest period."""
    found = periodic_runs(planted(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.l") * 1000 / -F.col("best.p")).alias("exponent_milli"), F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
