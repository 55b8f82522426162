"""Language-model scoring by online logistic context mixing, beside an add-one unigram base.

A token is coded by bits: has it followed the last word before, is it a known word, and, for a word that no learning row has, its
spelling as a path in a tree over bytes. Each bit is predicted by several hashed contexts (the last word, the word before
it, what the last bits were, the text so far; inside a word the last two, three and four bytes and the whole prefix). ``mixing.Mixer`` adds the
predictions with gated weights, learnt online, and refines the sum. Which token follows is then given by exact counts of words and
of pairs of words over all learning rows: with a the mixed probability of the first bit and b that of the second,
P(w | v) = a c(v w) / c(v) + (1 - a) b c(w) / N. What is gathered thus grows with the input: every pair of words has a counter.
Tables and weights are one for the whole corpus. Weights are learnt, and the bits per byte of a learning row are found, without a row's own occurrence in any count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, stored
from . import blocks
from .mixing import GATES, ODDS, SEEN, Code, Mixer, fold, log2_likelihood, packed, slots
from .words import Words, chunks, mix, texts_of

BLOCK_BYTES = 6 << 20
TABLE_BITS = 18  # slots of a block's tables of hashed contexts over words; over bytes a quarter of that
STEP = 4096  # bits of one online step of the weights
_END = np.uint64(0x2545F4914F6CDD1D)  # the hash of the end token
_START = np.uint64(0x8CB92BA72F3D8DD7)


def held_out(column: str = "doc_id", modulus: int = 7, residue: int = 2):
    """True where crc32 of the id as text leaves the residue; a null id is a learning row."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == residue, F.lit(False))


def _totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _count_tokens(count: int):
    """Partial token counts of some texts as key lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, size = [], [], 0
        schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("symbols", pa.binary())])
        symbols = np.zeros(257, np.int64)

        def flush():
            k, n = _totals(np.concatenate(keys), np.concatenate(numbers))
            order, bounds = blocks.slices(blocks.partition_of(k, count), count)
            own = [order[bounds[p] : bounds[p + 1]] for p in range(count)]
            full = [p for p in range(count) if len(own[p])]
            columns = {"part": full, "keys": [k[own[p]].tobytes() for p in full], "counts": [n[own[p]].tobytes() for p in full], "symbols": [symbols.tobytes()] + [None] * (len(full) - 1)}
            symbols[:] = 0
            return pa.RecordBatch.from_pydict(columns, schema)

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b, body, offs in chunks(data, offsets):
                words = Words(body, offs, lower=True)
                k, n = _distinct(words.hashes())
                symbols[:256] += np.bincount(words.data, minlength=256)
                symbols[256] += n.sum()
                keys += [k, np.array([_END])]
                numbers += [n, np.array([b - a])]
                size += len(k)
                if size > 2_000_000:
                    k, n = _totals(np.concatenate(keys), np.concatenate(numbers))
                    keys, numbers, size = [k], [n], len(k)
                    if size > 1_000_000:
                        yield flush()
                        keys, numbers, size = [], [], 0
        if keys:
            yield flush()

    return run


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)


def _sum_counts(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    keys, counts = _totals(*(np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("keys", np.uint64), ("counts", np.int64))))
    symbols = sum((np.frombuffer(x, np.int64) for x in table.column("symbols").to_pylist() if x), np.zeros(257, np.int64))
    return pa.table({"part": pa.array([part], pa.int32()), "keys": [keys.tobytes()], "counts": [counts.tobytes()], "n_distinct": [len(keys)], "total": [int(counts.sum())], "symbols": [symbols.tobytes()]})


class Tokens:
    """The words and the end of each text: hashes, the token and the word before, the texts' first tokens."""

    def __init__(self, words: Words):
        hashes = words.hashes()
        n, texts = len(hashes), len(words.offsets) - 1
        self.ends = words.first[1:] + np.arange(texts)
        self.is_word = np.ones(n + texts, bool)
        self.is_word[self.ends] = False
        self.hash = np.full(n + texts, _END)
        self.hash[self.is_word] = hashes
        self.first = np.concatenate([[0], self.ends + 1])
        self.size = np.diff(self.first)
        self.start = np.repeat(self.first[:-1], self.size)
        self.before = np.empty_like(self.hash)
        self.before[1:] = self.hash[:-1]
        self.before[self.first[:-1]] = _START

    def pairs(self) -> np.ndarray:
        return mix(self.hash + mix(self.before + np.uint64(0x51)))


def _steps(keys: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of sorted keys, as compressed steps from one to the next; with a key's partition 6 bytes tell pairs apart."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _whole(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 8 * width) - 1)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Tokens, Words, np.ndarray]:
    """(row order, whether each row is held out, tokens, words, which tokens are of learning rows) of a block."""
    order, _ = blocks.in_order(table)
    held = table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)[order].astype(bool)
    data, offsets = texts_of(table.column("text").take(pa.array(order)))
    words = Words(data[offsets[0] : offsets[-1]], offsets - offsets[0], lower=True)
    tokens = Tokens(words)
    return order, held, tokens, words, ~np.repeat(held, tokens.size)


def _lists(keys: np.ndarray, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, the places of each partition's keys among them)."""
    keys = _distinct(keys)[0]
    bounds = np.searchsorted(blocks.partition_of(keys, count), np.arange(count + 1))
    return keys, [np.arange(a, b) for a, b in zip(bounds[:-1], bounds[1:])]


_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])


def _ask(count: int):
    """A block's distinct tokens and pairs of tokens as key lists, with how often its learning rows have each pair."""

    def run(table: pa.Table) -> pa.Table:
        _, _, tokens, _, learning = _block(table)
        keys, key_parts = _lists(np.append(tokens.hash, _END), count)
        all_pairs = tokens.pairs()
        pairs, pair_parts = _lists(all_pairs, count)
        taught, n = _distinct(all_pairs[learning])
        counts = np.zeros(len(pairs), np.uint32)
        counts[np.searchsorted(pairs, taught)] = n
        full = [p for p in range(count) if len(key_parts[p]) or len(pair_parts[p])]
        pack = zstandard.ZstdCompressor(level=1).compress
        block = table.column("block")[0].as_py()
        columns = {"part": full, "block": [block] * len(full), "keys": [_steps(keys[key_parts[p]], 8) for p in full], "pairs": [_steps(pairs[pair_parts[p]], 6) for p in full], "counts": [pack(counts[pair_parts[p]].tobytes()) for p in full]}
        return pa.table(columns, _ASKED)

    return run


def _reply(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """Counts over all learning rows of each block's tokens and pairs, in the order in which they came."""
    known, known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counted.num_rows:
        known, known_counts = np.frombuffer(counted.column("keys")[0].as_py(), np.uint64), np.frombuffer(counted.column("counts")[0].as_py(), np.int64)
    pairs = [_whole(x, 6) for x in asked.column("pairs").to_pylist()]
    sizes = np.cumsum([0, *map(len, pairs)])
    counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(zstandard.decompress(x), np.uint32) for x in asked.column("counts").to_pylist())])
    _, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]), return_inverse=True)
    total = np.bincount(place, counts, minlength=1).astype(np.uint32)[place] if len(place) else counts
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = {"block": asked.column("block").to_pylist(), "part": asked.column("part").to_pylist(), "counts": [], "pairs": []}
    for k, own in enumerate(asked.column("keys").to_pylist()):
        want = _whole(own, 8)
        at = np.minimum(np.searchsorted(known, want), max(len(known) - 1, 0))
        found = np.where(known[at] == want, known_counts[at], 0) if len(known) else np.zeros(len(want), np.int64)
        rows["counts"].append(pack(found.tobytes()))
        rows["pairs"].append(pack(total[sizes[k] : sizes[k + 1]].tobytes()))
    return pa.table(rows, pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("pairs", pa.binary())]))


def _spread(keys: np.ndarray, parts: list[int], replies: list[bytes], kind) -> np.ndarray:
    """The answer for each of a block's keys from what the partitions said about its sorted distinct keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    answers = [np.frombuffer(zstandard.decompress(x), kind) for _, x in sorted(zip(parts, replies))]  # partitions are ranges of keys
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate([np.zeros(0, kind), *answers])[np.cumsum(new) - 1]
    return out


def _so_far(bit: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log odds of a one by the text's own earlier bits, where ``counts`` says that there was one."""
    odds = []
    for x in (bit & counts, ~bit & counts):
        sums = np.concatenate([[0], np.cumsum(x)])
        odds.append(np.log((sums[:-1] - sums[start]).astype(np.float32) + np.float32(0.4)))
    return odds[0] - odds[1]


def _history(bit: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bits of the text, 0 where there were fewer."""
    index, out = np.arange(len(bit)), np.zeros(len(bit), np.uint32)
    for k in range(1, length + 1):
        out[k:] |= np.where(index[k:] - k >= start[k:], bit[:-k], False).astype(np.uint32) << np.uint32(k - 1)
    return out


class BitModel:
    """Predicts one of a token's bits: a table for each (context, bits), the text so far, gated weights.

    Tables and weights hold what the bits of all learning rows say. While weights are learnt, in steps of ``STEP`` bits, a bit's own count is
    taken out of the tables.
    """

    def __init__(self, bits: list[int]):
        self.bits, self.tables = bits, []
        inputs = len(bits) + 1
        self.mixer = Mixer(inputs, np.full((GATES, inputs + 1), 1 / inputs))

    def _inputs(self, contexts: list[np.ndarray], so_far: np.ndarray, kind: np.ndarray, bit: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        x, gate = np.empty((len(contexts) + 2, len(bit)), np.float32), kind.astype(np.intp)
        for k, (context, bits, table) in enumerate(zip(contexts, self.bits, self.tables)):
            pair = table[_place(context, bits)]
            if own is not None:
                has = np.where(bit, pair & np.uint16(255), pair >> np.uint16(8)) > 0
                pair = pair - np.where(bit, np.uint16(1), np.uint16(256)) * (has & own)
            pair = pair.astype(np.intp)
            x[k] = ODDS[pair]
            if k < 2:
                gate = gate * 3 + SEEN[pair]
        x[-2], x[-1] = so_far, 0.3
        return x, gate

    def counts(self, contexts, so_far, kind, bit: np.ndarray, taught: np.ndarray) -> list[np.ndarray]:
        """How often each slot of each table saw a zero and a one."""
        return [np.bincount(_place(context[taught], bits) * 2 + bit[taught], minlength=2 << bits) for context, bits in zip(contexts, self.bits)]

    def teach(self, contexts, so_far, kind, bit: np.ndarray, taught: np.ndarray) -> None:
        chosen = np.flatnonzero(taught)
        for a in range(0, len(chosen), STEP):
            now = chosen[a : a + STEP]
            x, gate = self._inputs([c[now] for c in contexts], so_far[now], kind[now], bit[now], np.ones(len(now), bool))
            self.mixer.learn(x, gate, np.zeros(len(now), np.uint8), bit[now].astype(np.float32))

    def fit(self, *rest) -> None:
        self.tables = [packed(x) for x in self.counts(*rest)]
        self.teach(*rest)

    def probability(self, contexts, so_far, kind, bit: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Of a one, for each bit; the counts of bits that are ``own`` are taken out of the tables."""
        out = np.zeros(len(bit))
        for a in range(0, len(bit), 1 << 14):
            now = slice(a, a + (1 << 14))
            x, gate = self._inputs([c[now] for c in contexts], so_far[now], kind[now], bit[now], None if own is None else own[now])
            out[now] = 1 / (1 + np.exp(-self.mixer.refined(self.mixer.mixed(x, gate), np.zeros(len(gate), np.uint8))[0].astype(np.float64)))
        return out


def _place(context: np.ndarray, bits: int) -> np.ndarray:
    return (context * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.intp)


class TokenModel:
    """Probabilities of tokens from exact counts and two mixed bits; words that no learning row has are one kind.

    ``single`` and ``pair`` are the counts of the token and of it with the token before; ``total`` and ``texts`` those of all
    learning tokens and texts.
    """

    def __init__(self, tokens: Tokens, single: np.ndarray, pair: np.ndarray, total: int, texts: int, table_bits: int):
        self.tokens, self.single, self.pair, self.total = tokens, single, pair, total
        self.before = np.empty_like(single)
        self.before[1:] = single[:-1]
        self.before[tokens.first[:-1]] = texts
        second = np.empty_like(tokens.before)
        second[1:] = tokens.before[:-1]
        second[tokens.first[:-1]] = _START
        self.low, self.far = ((h >> np.uint64(32)).astype(np.uint32) for h in (tokens.before, second))
        self.place = np.minimum(np.log2(np.arange(len(single)) - tokens.start + 1).astype(np.uint32), 8)
        few = min(12, table_bits)
        self.follows, self.known = BitModel([table_bits, few, table_bits, few]), BitModel([table_bits, few, table_bits, few])

    def _bits(self, own: np.ndarray):
        """For each of the two bits: contexts, the text so far, outer gate, bit, whether there is one."""
        before = self.before - own
        follows, known, has = self.pair > own, self.single > own, before > 0
        start, size, always = self.tokens.start, np.minimum(np.log2(np.maximum(before, 0) + 1), 15).astype(np.uint32), np.ones(len(own), bool)
        past, past_known = _history(follows, start, 6), _history(known, start, 6)
        first = [fold(self.low), fold(past, size), fold(self.far, size), fold(size, self.place, past & np.uint32(3))]
        second = [fold(self.low), fold(past_known, past & np.uint32(7)), fold(self.far), fold(size, self.place)]
        return ((first, _so_far(follows, has, start), np.minimum(size, 8), follows), has), ((second, _so_far(known, always, start), self.place, known), always)

    def _taught(self, learning: np.ndarray):
        return [(model, (*rest, learning & has)) for model, (rest, has) in zip((self.follows, self.known), self._bits(learning.astype(np.int64)))]

    def counts(self, learning: np.ndarray) -> list[np.ndarray]:
        """Of all tables, from these tokens."""
        return [x for model, rest in self._taught(learning) for x in model.counts(*rest)]

    def teach(self, learning: np.ndarray) -> None:
        """The weights, from these tokens and the tables as they are."""
        for model, rest in self._taught(learning):
            model.teach(*rest)

    def learn(self, learning: np.ndarray) -> None:
        """Tables and weights from these tokens alone."""
        for model, rest in self._taught(learning):
            model.fit(*rest)

    def probability(self, own: np.ndarray | None = None) -> np.ndarray:
        """Of each token; where it is ``own``, without its own occurrence in any count."""
        one = np.zeros(len(self.single), np.int64) if own is None else own.astype(np.int64)
        (first, has), (second, _) = self._bits(one)
        a = np.where(has, self.follows.probability(*first, None if own is None else own & has), 0)
        b = self.known.probability(*second, own)
        lower = np.where(self.single > one, b * (self.single - one) / np.maximum(self.total - one, 1), 1 - b)
        return a * (self.pair - one) / np.maximum(self.before - one, 1) + (1 - a) * lower


def _spelling_contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(byte symbols with ends, first symbol of each word, contexts)."""
    length = end - start
    first = np.concatenate([[0], np.cumsum(length + 1)])
    word = np.repeat(np.arange(len(start)), length + 1)
    inside = np.arange(first[-1]) - first[word]
    symbols = np.where(inside < length[word], data[np.minimum(start[word] + inside, max(len(data) - 1, 0))], 256).astype(np.int64)
    back = [np.where(inside >= k, symbols[np.maximum(np.arange(len(symbols)) - k, 0)], 257) for k in (1, 2, 3, 4)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(1) + (inside.astype(np.uint64) << np.uint64(16))))])
    prefix = mix(sums[:-1] - sums[first[word]])
    pair = fold(back[0], back[1])
    return symbols, first, [pair, fold(pair, back[2]), fold(pair, back[2], back[3]), fold(prefix, (prefix >> np.uint64(32)))]


class Spelling:
    """The words ``at`` as bits of paths; those that are ``taught`` teach, and their own bits are taken out of the tables."""

    def __init__(self, words: Words, at: np.ndarray, taught: np.ndarray, code: Code, table_bits: int):
        self.words, self.at, self.taught, self.code, self.table_bits = words, at, taught, code, table_bits
        self.tables, self.mixer = [], Mixer(5)

    def _pieces(self, only_taught: bool):
        chosen = np.flatnonzero(self.taught) if only_taught else np.arange(len(self.at))
        for a in range(0, len(chosen), 3000):
            own = chosen[a : a + 3000]
            symbols, first, contexts = _spelling_contexts(self.words.data, self.words.start[self.at[own]], self.words.end[self.at[own]])
            length, _, bit, where = slots(self.code, symbols, contexts, self.table_bits)
            bounds = np.concatenate([[0], np.cumsum(length)])[first[:-1]]
            yield own, bit, where, bounds, np.repeat(self.taught[own], np.diff(np.append(bounds, len(bit))))

    def counts(self) -> list[np.ndarray]:
        tables = [np.zeros(2 * n, np.int64) for n in [len(self.code.depth)] + [1 << self.table_bits] * 4]
        for _, bit, where, _, _ in self._pieces(True):
            for t, place in zip(tables, where):
                t += np.bincount(place.astype(np.intp) * 2 + bit, minlength=len(t))
        return tables

    def _inputs(self, bit, where, teach):
        depth = self.code.depth[where[0]]
        return *Mixer.inputs(self.tables, where, depth, bit == 1, teach), depth

    def teach(self) -> None:
        for _, bit, where, _, teach in self._pieces(True):
            x, gate, depth = self._inputs(bit, where, teach)
            self.mixer.learn(x, gate, depth, bit.astype(np.float32))

    def cost(self) -> np.ndarray:
        """log2 probability of the spelling of each word."""
        out = np.zeros(len(self.at))
        for own, bit, where, bounds, teach in self._pieces(False):
            x, gate, depth = self._inputs(bit, where, teach)
            out[own] = np.add.reduceat(log2_likelihood(self.mixer.refined(self.mixer.mixed(x, gate), depth)[0], bit).astype(np.float64), bounds)
        return out


@dataclass
class Model:
    """What all blocks share: numbers of learning tokens, the code of spellings, then all tables, packed, one after the other, and the three mixers' states."""

    table_bits: int
    total: int
    distinct: int
    code: Code
    tables: np.ndarray | None = None
    states: list[np.ndarray] | None = None

    def sizes(self) -> list[int]:
        few = min(12, self.table_bits)
        return [2 << b for b in [self.table_bits, few] * 4] + [2 * len(self.code.depth)] + [2 << self.table_bits - 2] * 4


class Block:
    """A block's rows with the counts of their tokens, under ``model``."""

    def __init__(self, docs: pa.Table, replies: pa.Table, model: Model):
        self.model = model
        order, self.held, self.tokens, self.words, self.learning = _block(docs)
        self.ids = docs.column("doc_id").take(pa.array(order))
        parts = replies.column("part").to_pylist()
        single = _spread(np.append(self.tokens.hash, _END), parts, replies.column("counts").to_pylist(), np.int64)
        self.single = single[:-1]
        pair = _spread(self.tokens.pairs(), parts, replies.column("pairs").to_pylist(), np.uint32)
        self.known = TokenModel(self.tokens, self.single, pair, model.total, int(single[-1]), model.table_bits)
        is_word = self.tokens.is_word
        self.where = np.flatnonzero((self.single - self.learning == 0)[is_word])
        self.spelling = Spelling(self.words, self.where, self.learning[is_word][self.where], model.code, model.table_bits - 2)
        three = self.known.follows, self.known.known, self.spelling
        if model.tables is not None:
            tables = np.split(model.tables, np.cumsum(model.sizes())[:-1] // 2)
            for own, some in zip(three, (tables[:4], tables[4:8], tables[8:])):
                own.tables = some
        for own, state in zip(three, model.states or []):
            own.mixer.take(state)

    def counts(self) -> np.ndarray:
        return np.concatenate(self.known.counts(self.learning) + self.spelling.counts())

    def states(self) -> list[np.ndarray]:
        self.known.teach(self.learning)
        self.spelling.teach()
        return [own.mixer.state() for own in (self.known.follows, self.known.known, self.spelling)]

    def scores(self) -> pa.Table:
        by_text = lambda x: np.add.reduceat(x, self.tokens.first[:-1])  # noqa: E731  every text has a token: its end
        base = by_text(np.log10((self.single + 1) / (self.model.total + self.model.distinct + 1)))
        score, alone = (by_text(np.log10(np.maximum(self.known.probability(own), 1e-300))) for own in (None, self.learning))
        spelt = np.zeros(len(self.words.start))
        spelt[self.where] = self.spelling.cost()
        spelling = np.zeros(len(self.tokens.hash))
        spelling[self.tokens.is_word] = spelt
        bits = -alone / np.log10(2) - by_text(spelling)
        return pa.table(
            {
                "doc_id": self.ids, "held_out": self.held, "n_tokens": self.tokens.size, "n_known": by_text((self.single > 0).astype(np.int64)), "base_score": base,
                "train_tokens": np.full(len(self.held), self.model.total), "score": score, "bits_per_byte": bits / np.maximum(np.diff(self.words.offsets), 1),
            }
        )


_KEPT = pa.schema([("docs", pa.binary()), ("replies", pa.binary()), ("counts", pa.binary())])
_PARTS = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
_SUMS = "part int, sums binary"
RANGES = 64  # of slots, over all tables
FILE_BLOCKS = 4  # blocks that one file keeps


def _kept(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(model: Model):
    """A block kept whole, with its replies and the counts of its learning rows for all tables."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        counts = zstandard.compress(Block(docs, replies, model).counts().astype(np.uint32).tobytes(), 1)
        out = pa.table({"docs": [_kept(docs.drop_columns("block"))], "replies": [_kept(replies.drop_columns("block"))], "counts": [counts]}, _KEPT)
        blocks.release()
        return out

    return run


def _sum_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's blocks, by ranges of slots."""
    total = None
    for batch in batches:
        for x in batch.column("counts"):
            counts = np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
            total = counts.astype(np.int64) if total is None else total + counts
    if total is not None:
        yield pa.RecordBatch.from_pydict({"part": range(RANGES), "sums": [zstandard.compress(x.tobytes(), 1) for x in np.array_split(total.reshape(-1, 2), RANGES)]}, _PARTS)


def _pack_tables(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in table.column("sums"))
    return pa.table({"part": [table.column("part")[0].as_py()], "sums": [packed(total).tobytes()]}, _PARTS)


def _blocks_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(*(pa.ipc.open_stream(batch.column(c)[k].as_buffer()).read_all() for c in ("docs", "replies")), model)
            blocks.release()


def _learnt(model: Model):
    """The added states of the mixers after each of a task's blocks has taught them from their beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks_of(batches, model):
            states = block.states()
            total = states if total is None else [a + b for a, b in zip(total, states)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": range(len(total)), "sums": [x.tobytes() for x in total]}, _PARTS)

    return run


def _add_states(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"part": [table.column("part")[0].as_py()], "sums": [total.tobytes()]}, _PARTS)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, model):
            yield from block.scores().to_batches()

    return run


def _by_part(rows: DataFrame, kind) -> list[np.ndarray]:
    return [np.frombuffer(r.sums, kind) for r in rows.orderBy("part").collect()]


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double, bits_per_byte double"


def score(docs: DataFrame, modulus: int = 7, residue: int = 2, table_bits: int = TABLE_BITS) -> DataFrame:
    """Scores every text; rows whose crc32(doc_id) mod ``modulus`` is ``residue`` are held out of all learning.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the tokens
    by the base and the model; to both, words that no learning row has are one kind of token) and bits_per_byte, which adds the spelling
    of such words and takes a learning row's tokens out of the counts one by one, so that a text which occurs once doesn't look well known. Null text is empty: one end token. Every row is scored, repeated rows
    alike; with no learning rows at all the base gives each token probability 1. Other columns are not read.

    Counts of tokens and pairs of tokens are exact over all learning rows and exchanged by key lists. Rows are dealt by the hash of doc_id and text into
    blocks of ``BLOCK_BYTES``, whatever the cluster. Three passes go over the blocks: the tables of hashed contexts are sums of all blocks' counts, of all learning
    rows; with these tables each block's learning rows teach weights, whose means over all blocks, by the bits that taught them, are the model's; then all rows are scored.
    Tables and weights have a fixed size. Key lists' answers and then blocks with their counts are written to the checkpoint folder, the shuffles before them removed, and only they are read again.
    """
    docs = blocks.texts(docs)
    _, size = blocks.volume(docs)
    count = blocks.partition_count(size // 5)  # about a pair of words for each six bytes
    learning = docs.where(~held_out(modulus=modulus, residue=residue))
    counted = learning.select("text").mapInArrow(_count_tokens(count), "part int, keys binary, counts binary, symbols binary").groupBy("part")
    counted = durable(counted.applyInArrow(_sum_counts, "part int, keys binary, counts binary, n_distinct long, total long, symbols binary"))
    n = counted.agg(F.sum("n_distinct"), F.sum("total")).first()
    distinct, total = n[0] or 0, n[1] or 0
    symbols = sum((np.frombuffer(r.symbols, np.int64) for r in counted.select("symbols").toLocalIterator()), np.zeros(257, np.int64))
    model = Model(table_bits, total, distinct, Code.of(symbols))
    number = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).cast("int").alias("block")
    dealt = docs.select(block, held_out(modulus=modulus, residue=residue).alias("held_out"), "doc_id", "text")
    asked = dealt.groupBy("block").applyInArrow(_ask(count), "part int, block int, keys binary, pairs binary, counts binary")
    replies = stored(asked.groupBy("part").cogroup(counted.drop("symbols").groupBy("part")).applyInArrow(_reply, "block int, part int, counts binary, pairs binary"), lean=True)
    kept = stored(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_counted(model), "docs binary, replies binary, counts binary"), FILE_BLOCKS, lean=True)
    tables = _by_part(kept.select("counts").mapInArrow(_sum_tables, _SUMS).groupBy("part").applyInArrow(_pack_tables, _SUMS), np.uint16)
    if not tables:
        return docs.sparkSession.createDataFrame([], _RESULT)
    model.tables = np.concatenate(tables)
    rows = kept.select("docs", "replies")
    model.states = _by_part(rows.mapInArrow(_learnt(model), _SUMS).groupBy("part").applyInArrow(_add_states, _SUMS), np.float64)
    return rows.mapInArrow(_scored(model), _RESULT)


def digest(docs: DataFrame) -> DataFrame:
    """op6's contract."""
    return score(docs)
