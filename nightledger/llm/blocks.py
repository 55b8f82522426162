"""Documents dealt into blocks of a few MB, and the exchange of per-block key lists.

Several operators ask a question of every line or window of the whole corpus ("does this occur earlier?").
One row for each would cost far more than the text itself, so every block sends one packed list
of 64-bit keys to each key partition and gets back a packed list of answers. Blocks and key lists are bounded;
a key that is common in the corpus is sent once by each block at most.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
ROW_BYTES = 64  # what a row weighs beside its text, where rows of one doc_id are counted
TABLE_BYTES = 256 << 20
KEYS_A_PARTITION = 2 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The two columns that the operators read, under fixed names; other columns cannot clash. Null text is empty.

    With ``carry`` the other columns and whether the text was null go along as the struct ``rest``; see ``restored``.
    """
    text = F.col(f"`{text_col}`").cast("string")
    out = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")]
    if carry:
        out.append(F.struct(F.when(text.isNull(), True).alias("_no_text"), *(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest"))
    return docs.select(*out)


def restored(found: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``like`` from a result with text and rest; a text that was null and is still empty is null again."""
    text = F.when(F.coalesce(F.col("rest._no_text"), F.lit(False)) & (F.col("text") == ""), F.lit(None)).otherwise(F.col("text")).alias(text_col)
    return found.select(*(text if c == text_col else F.col("rest").getField(c).alias(c) for c in like.columns))


def sql_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def volume(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) of what ``texts`` returns: two numbers, however large the corpus is."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0


def release() -> None:
    """Gives freed Arrow and heap memory back: a Python worker lives on through later stages, and freed arrays of middling size stay in its heap otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries have none
    if trim:
        trim(0)


def table_tasks(docs: DataFrame, total_bytes: int) -> int:
    """Tasks that each build one table of counts: no more than needed, but none has over ``TABLE_BYTES`` of text."""
    return max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // TABLE_BYTES))


def block_count(total_bytes: int) -> int:
    return max(1, -(-total_bytes // BLOCK_BYTES))


def partition_count(keys: int) -> int:
    return max(1, -(-keys // KEYS_A_PARTITION))


def crowded(docs: DataFrame, count: int) -> list[tuple[int | None, int, int]]:
    """(doc_id, first block, blocks) of the doc_ids, null too, whose rows are more than a block; their blocks follow the ``count`` others.

    There is at most one for each block's bytes of the corpus.
    """
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("b")).where(F.col("b") > BLOCK_BYTES).collect()
    out, at = [], count
    for doc_id, size in sorted(sizes, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((doc_id, at, block_count(size)))
        at += block_count(size)
    return out


def with_block(docs: DataFrame, count: int, spread: list[tuple[int | None, int, int]] | None = None) -> DataFrame:
    """Rows with the same doc_id come to the same block, but those of ``crowded`` ones to several, by ranges of the text's hash.

    Rows of one doc_id are thus in the order of (block, text). Rows of one doc_id and one text are always together.
    """
    spread = crowded(docs, count) if spread is None else spread
    plain = block_of(F.col("doc_id"), count)
    if not spread:
        return docs.select(plain.alias("block"), *docs.columns)
    table = F.broadcast(docs.sparkSession.createDataFrame(spread, "_id long, _at int, _parts int"))
    place = F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("text"), 33) * F.col("_parts"), 31)
    joined = docs.join(table, docs["doc_id"].eqNullSafe(table["_id"]), "left")
    return joined.select(F.coalesce(F.col("_at") + place, plain).cast("int").alias("block"), *docs.columns)


def block_of(doc_id: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(count)).cast("int")


def partition_of(keys: np.ndarray, count: int) -> np.ndarray:
    """0 .. count-1 by the upper half of each key."""
    return (((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def slices(part: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): items of partition p are order[bounds[p]:bounds[p+1]], in their old order."""
    order = np.argsort(part.astype(np.uint16) if count < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(count + 1))


def in_order(table) -> tuple[np.ndarray, np.ndarray]:
    """Row order of a block by doc_id (null last), then text; and the doc_ids in that order."""
    ids = table.column("doc_id").combine_chunks()
    values = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    if len(values) > 1 and (np.diff(values[order]) == 0).any():
        text = table.column("text").to_pylist()
        order = np.array(sorted(range(len(values)), key=lambda i: (values[i], text[i])), np.int64)
    return order, values[order]
