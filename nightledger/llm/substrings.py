"""Substring dedup: repeated fixed-length word windows merge into maximal removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import Words, chunks, mix, string_column, texts_of, windows

_OTHER = np.uint64(0x3C79AC492BA7B653)
_KEYS = "part int, block int, keys binary, ids binary, counts binary"
_ANSWER = "block int, part int, repeated binary"


def _block_windows(table: pa.Table, width: int):
    """The block's windows in corpus order: hashes, second hashes, windows of each document, the words of each chunk.

    The second hash deals windows to partitions, so two windows are confused only if they agree in it that far and in the whole first hash.
    """
    order, ids = blocks.in_order(table)
    data, offsets = texts_of(table.column("text").take(pa.array(order)))
    none = np.zeros(0, np.uint64)
    hashes, others, counts, parts = [none], [none], [], []
    for _, _, body, offs in chunks(data, offsets):
        words = Words(body, offs)
        of_words = words.hashes()
        h, at, n = windows(of_words, words.first, width)
        hashes.append(h)
        others.append(windows(mix(of_words ^ _OTHER), words.first, width, 0x9FB21C651E98DF25)[0])
        counts.append(n)
        parts.append((words, at))
    hashes = np.concatenate(hashes)
    _, first = np.unique(hashes, return_index=True)
    return order, ids, hashes, np.concatenate(others), np.concatenate([np.zeros(0, np.int64), *counts]), np.sort(first), parts


def _send(width: int, count: int):
    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, ids, hashes, others, counts, first, _ = _block_windows(table, width)
        keys, doc = hashes[first], np.repeat(np.arange(len(ids)), counts)[first]
        order, bounds = blocks.slices(blocks.partition_of(others[first], count), count)
        rows = {"part": [], "block": [], "keys": [], "ids": [], "counts": []}
        for p in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[p] : bounds[p + 1]]
            of, n = np.unique(doc[own], return_counts=True)
            for name, value in (("part", int(p)), ("block", block), ("keys", keys[own].tobytes()), ("ids", ids[of].tobytes()), ("counts", n.astype(np.int32).tobytes())):
                rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())]))

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Of each list, which keys another block holds at a smaller doc_id, or in an earlier block of the same doc_id."""
    lists = table.to_pylist()
    keys = np.concatenate([np.frombuffer(x["keys"], np.uint64) for x in lists])
    doc = np.concatenate([np.repeat(np.frombuffer(x["ids"], np.int64), np.frombuffer(x["counts"], np.int32)) for x in lists])
    block = np.repeat([x["block"] for x in lists], [len(x["keys"]) // 8 for x in lists])
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.empty(len(keys) + 1, bool)
    same[0] = same[-1] = False
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared = order[same[1:] | same[:-1]]
    shared = shared[np.lexsort((block[shared], doc[shared], keys[shared]))]
    later = np.zeros(len(keys), bool)
    later[shared[1:]] = keys[shared[1:]] == keys[shared[:-1]]
    out = {"block": [], "part": [], "repeated": []}
    at = 0
    for x in lists:
        n = len(x["keys"]) // 8
        if later[at : at + n].any():
            out["block"].append(x["block"])
            out["part"].append(x["part"])
            out["repeated"].append(np.packbits(later[at : at + n]).tobytes())
        at += n
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("repeated", pa.binary())]))


def _cut(width: int, count: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order, ids, hashes, others, _, first, parts = _block_windows(docs, width)
        repeated = np.ones(len(hashes), bool)
        repeated[first] = False
        if len(first) and answers.num_rows:
            own, bounds = blocks.slices(blocks.partition_of(others[first], count), count)
            for p, bits in zip(answers.column("part").to_pylist(), answers.column("repeated").to_pylist()):
                mine = first[own[bounds[p] : bounds[p + 1]]]
                repeated[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
        kept, n_words, n_removed, done = [], [], [], 0
        for words, at in parts:
            n = len(words.start)
            edge = np.zeros(n + 1, np.int64)
            hit = at[repeated[done : done + len(at)]]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + width, -1)  # at + width is n at most
            done += len(at)
            stay = np.cumsum(edge[:-1]) == 0
            raw, start, end = words.data.tobytes(), words.start, words.end
            for i in range(len(words.first) - 1):
                a, b = words.first[i], words.first[i + 1]
                mask = stay[a:b]
                kept.append(b" ".join([raw[s:e] for s, e in zip(start[a:b][mask].tolist(), end[a:b][mask].tolist())]))
                n_words.append(b - a)
                n_removed.append(b - a - int(mask.sum()))
        raw_ids = docs.column("doc_id").take(pa.array(order))
        return pa.table({"doc_id": raw_ids.combine_chunks(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": string_column(kept)})

    return cut


def remove_repeated_windows(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a repeated window of ``width`` words covers; the earliest copy of a window stays.

    Earlier means a smaller doc_id, or the same document and an earlier start. Overlapping and adjoining
    repeated windows merge, so a repeated passage goes as one maximal interval. Windows are judged on the input.
    Returns doc_id, n_words, n_removed and text (the kept words joined by one space), a row for each input row.

    Null text counts as empty; a text of fewer words than ``width`` keeps all of them. Rows of equal doc_id are
    judged in the order of their texts (of their blocks first, see ``blocks.with_block``), null doc_ids come last. Other columns are not read.
    Windows are told apart by 64-bit hashes within a partition of ``blocks.KEYS_A_PARTITION``, to which a second hash deals them: of n
    different windows about n * KEYS_A_PARTITION / 2**65 are taken for another one (0.0003 in 30 GB).
    """
    docs = blocks.texts(docs, id_col, text_col)
    _, size = blocks.volume(docs)
    count = blocks.partition_count(size // 6)  # about a window for each word of 6 bytes
    dealt = blocks.with_block(docs, blocks.block_count(size))
    lists = dealt.groupBy("block").applyInArrow(_send(width, count), _KEYS)
    answers = lists.groupBy("part").applyInArrow(_answer, _ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(width, count), "doc_id long, n_words long, n_removed long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """op10's contract."""
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
