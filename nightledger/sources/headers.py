"""Image headers by byte ranges: a data source that plans partitions over files and reads no more than their headers.

``spark.read.format("image_headers")`` gives a row for each file: path, length, bytes_read, magic (the first eight bytes) and headers (the raw header
blocks). Images are tens of MB, their headers some KB; what is read of a file is bounded by its header, whatever its size.
"""

from __future__ import annotations

import fnmatch
import itertools
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# FITS headers come in blocks of 2,880 bytes, in cards of 80, up to the card END.
BLOCK, CARD = 2880, 80
XISF_MAGIC = b"XISF0100"
FILES_A_PARTITION = 256
THREADS = 8  # files that a task reads at once; reads are short, so a remote store's delay is what takes time
COLUMNS = "path string, length long, bytes_read long, magic binary, headers array<binary>"


def expanded(pattern: str) -> list[str]:
    """The patterns that a glob with braces stands for."""
    parts = [p.split(",") if k % 2 else [p] for k, p in enumerate(re.split(r"\{([^{}]*)\}", pattern))]
    return ["".join(x) for x in itertools.product(*parts)]


class Ranges:
    """Reads at places of one file, and counts the bytes."""

    def __init__(self, file):
        self.file, self.taken = file, 0

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(size)
        self.taken += len(data)
        return data


def header_end(block: bytes) -> bool:
    return any(block[k : k + CARD].rstrip() == b"END" for k in range(0, len(block), CARD))


def fits_header(ranges: Ranges, start: int) -> bytes | None:
    """The blocks from ``start`` to the one with END; None if the file ends before."""
    blocks = []
    while True:
        block = ranges.at(start + BLOCK * len(blocks), BLOCK)
        blocks.append(block)
        if header_end(block):
            return b"".join(blocks)
        if len(block) < BLOCK:
            return None


def without_data(header: bytes) -> bool:
    cards = (header[k : k + CARD] for k in range(0, len(header), CARD))
    return any(re.match(rb"NAXIS   = +0\b", c) for c in cards)


def read_headers(file, kind: str, size: int) -> tuple[int, bytes, list[bytes]]:
    """(bytes read, first eight bytes, headers) of an open file.

    FITS: the first header, and where no data follow it (as in compressed files) the first extension's too. XISF: the XML, whose length the bytes 9 to 12 say.
    """
    ranges = Ranges(file)
    if kind == "fits":
        first = fits_header(ranges, 0)
        found = [] if first is None else [first]
        if found and without_data(first) and size > len(first):
            second = fits_header(ranges, len(first))
            found += [] if second is None or not second.startswith(b"XTENSION") else [second]
        return ranges.taken, first[:8] if first else b"", found
    start = ranges.at(0, 16 if kind == "xisf" else 8)
    found = []
    if kind == "xisf" and start[:8] == XISF_MAGIC and len(start) == 16:
        found = [ranges.at(16, min(struct.unpack("<I", start[8:12])[0], size - 16))]
    return ranges.taken, start[:8], found


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.kind, self.pattern = options["path"], options.get("kind", "magic"), options.get("pattern", "*")
        self.many = int(options.get("filesperpartition", FILES_A_PARTITION))

    def _store(self):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", self.root))

    def partitions(self) -> list[Files]:
        store, root = self._store()
        patterns = expanded(self.pattern)
        listed = store.get_file_info(root if store.get_file_info(root).type == pyarrow.fs.FileType.File else pyarrow.fs.FileSelector(root, recursive=True))
        listed = listed if isinstance(listed, list) else [listed]
        files = sorted((f.path, f.size) for f in listed if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith(("_", ".")) and any(fnmatch.fnmatchcase(f.base_name, p) for p in patterns))
        return [Files(files[k : k + self.many]) for k in range(0, len(files), self.many)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        scheme = "file" if isinstance(store, pyarrow.fs.LocalFileSystem) else store.type_name

        def one(file: tuple[str, int]):
            path, size = file
            with store.open_input_file(path) as source:
                taken, magic, found = read_headers(source, self.kind, size)
            return f"{scheme}:{path}" if scheme == "file" else f"{scheme}://{path}", size, taken, magic, found

        with ThreadPoolExecutor(THREADS) as pool:
            for k in range(0, len(partition.files), 64):
                path, size, taken, magic, found = zip(*pool.map(one, partition.files[k : k + 64]))
                columns = [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(taken, pa.int64()), pa.array(magic, pa.binary()), pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "length", "bytes_read", "magic", "headers"])


class HeaderSource(DataSource):
    """Options: path (a folder, read with all below it, or a file), kind (fits, xisf or magic), pattern (glob with braces), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def read_image_headers(spark: SparkSession, root: str, kind: str, pattern: str = "*") -> DataFrame:
    """path, length, bytes_read, magic and headers of the files below ``root``; see ``read_headers``."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("image_headers").option("kind", kind).option("pattern", pattern).load(root)
