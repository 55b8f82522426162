"""SentencePiece models rebuilt for the tokenizers library.

``parse_model`` reads the model's protobuf; ``rebuild`` makes the same normaliser, space marker, pieces with their scores and
byte fallback there, so that whole batches are encoded by threads in one call. Both model kinds are known: unigram keeps
its scores, BPE turns them into an order of merges.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from . import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 1 << 20
CACHED_WORDS = 150_000  # of a task, before it starts anew
THREADS = 2  # of a task
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # (piece, score, kind)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    space_is_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or bytes for anything longer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + size]
            at += size


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            model.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind = own.get(3, UNIGRAM)
            model.space_is_suffix = bool(own.get(24, 0))
            model.byte_fallback = bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix = bool(own.get(3, 1))
            model.strip_extra_spaces = bool(own.get(4, 1))
            model.escape_spaces = bool(own.get(5, 1))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which they merge: by the score of what they make. Of equal scores the longer piece goes first,
    so a run of marks grows from its left as it does where ties go to the leftmost pair."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in score and piece[cut:] in score:
                found.append((-s, -len(piece), -cut, piece[:cut], piece[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(model: Model) -> Tokenizer:
    if model.space_is_suffix:
        raise ValueError("models with the space marker as a suffix are not known")
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        # a text is never cut into the other kinds of pieces: they keep their ids under names that no text has
        lowest = min((s for _, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)), default=0.0)
        vocabulary = [(p, s) if kind in (NORMAL, USER_DEFINED) else (p if kind == BYTE else f"\uffff{i}\uffff", lowest) for i, (p, s, kind) in enumerate(model.pieces)]
        tokenizer = Tokenizer(models.Unigram(vocabulary, unknown, model.byte_fallback))
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tokenizer = Tokenizer(models.BPE(vocabulary, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"unknown kind of model: {model.kind}")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))  # an empty text stays empty
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.kind == BPE and not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        # no piece holds a mark after another character, so no merge crosses the start of a run of marks
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    elif model.kind == UNIGRAM and model.byte_fallback:
        # byte pieces must keep their names; a text that holds such a name is cut inside it
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("<0(?=x[0-9A-F]{2}>)"), "merged_with_previous")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


def normalised(model: Model, text: str) -> str:
    """What a text is after a round trip, for models without a character map that keep spaces."""
    return text.replace(MARK, " ") if model.escape_spaces else text


class Codec:
    """Encodes and decodes texts by their distinct words.

    A word is a run of marks with what follows up to the next mark. Where no piece holds a mark after another character
    (``apart``), a text's ids are those of its words one after the other, so the library encodes, and decodes again, each
    new word once, whole batches of them by threads; a text's decoded form is that of its words' ids one after the other. Other models' texts are encoded as they are.
    """

    def __init__(self, data: bytes):
        self.model = parse_model(data)
        self.whole = rebuild(self.model)
        names = {p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)}
        plain = not self.model.charsmap and not self.model.strip_extra_spaces and self.model.escape_spaces
        self.apart = plain and MARK in names and not any(MARK in p.lstrip(MARK) for p in names)
        self.words = rebuild(self.model)
        self.words.normalizer = normalizers.Sequence([])
        self.words.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.back: list[str] = []  # what each known word's ids decode to
        self.ids, self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        self.back += self.words.decode_batch(ids, skip_special_tokens=False)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))])

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool]]:
        """(ids of all texts, ids of each text, decoded texts, whether each is its normalised text)."""
        if not self.apart:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.whole.decode_batch(ids, skip_special_tokens=False)
            return np.array([i for own in ids for i in own], np.int32), np.array([len(x) for x in ids], np.int64), back, [b == normalised(self.model, t) for b, t in zip(back, texts)]
        if len(self.known) > CACHED_WORDS:
            self.forget()
        lead = MARK if self.model.dummy_prefix else ""
        cut = [_WORD.findall(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        new = [w for w in set(chain.from_iterable(cut)) if w not in self.known]
        if new:
            self._learn(new)
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(first[-1]))
        length = self.length[place]
        ends = np.cumsum(length)
        flat = self.ids[np.repeat(self.at[place] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        sizes = total[first[1:]] - total[first[:-1]]
        words = list(map(self.back.__getitem__, place.tolist()))
        skip = 1 if self.model.dummy_prefix else 0  # the prefix decodes to one space
        back = ["".join(words[a:b])[skip:] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        return flat, sizes, back, [b == normalised(self.model, t) for b, t in zip(back, texts)]


_CODECS: dict[bytes, Codec] = {}


def _of_worker(data: bytes) -> Codec:
    """The codec of this Python worker, which serves many tasks."""
    if data not in _CODECS:
        _CODECS.clear()
        _CODECS[data] = Codec(data)
    return _CODECS[data]


def _codec(model, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads != 1 else "false"
        codec = _of_worker(model.value)
        for batch in batches:
            at, column = 0, batch.column("text")
            size = np.cumsum([0, *pc.binary_length(column).to_pylist()])
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, size[at] + BATCH_BYTES, "right")) - 1)
                flat, sizes, back, same = codec.run(column.slice(at, end - at).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), ids, pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "decoded", "round_trip"])
                at = end
        codec.forget()  # a worker serves other stages too
        blocks.release()

    return run


def encode(docs: DataFrame, model_file: str = MODEL, threads: int = THREADS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (text) and round_trip (the decoded text is the normalised text), a row for each row.

    ``model_file`` is read on the driver and broadcast: vocabularies have a fixed size. ``threads`` is that of the encoder in each task. Null and empty texts have no ids. No special tokens are added, and their names in a text
    are ordinary text. Repeated rows and null doc_ids are kept; other columns are not read.
    """
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    return blocks.texts(docs, id_col, text_col).mapInArrow(_codec(model, threads), "doc_id long, ids array<int>, decoded string, round_trip boolean")


def parity(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id and same: whether the sentencepiece library itself gives the ids of ``encode``. A check, not needed for results."""
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        codec = Codec(model.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flat, sizes, _, _ = codec.run(texts)
            mine = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
            same = [a == b for a, b in zip(mine, own.encode(texts, num_threads=1))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.bool_())], ["doc_id", "same"])

    return blocks.texts(docs).mapInArrow(run, "doc_id long, same boolean")


def digest(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 and round_trip of every document."""
    found = encode(docs, model_file)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
