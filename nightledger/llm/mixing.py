"""Logistic context mixing over the bits of Huffman paths, in numpy.

A symbol is coded as the bits of its path in a Huffman tree. Each bit is predicted by several counters, one that knows
only the tree node and one for each hashed context with the node. The predictions, as log odds, are added with weights;
a gate (how deep the node is, how much the last three counters have seen) chooses the weights, which are learnt
online by gradient steps, and a last table, interpolated between knots, refines the mixed log odds.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

GATES = 81
KNOTS = 25
_SPAN = 12.0  # log odds are held within -12 .. 12


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """For a pair of counts packed in 16 bits: log odds of a one, and 0, 1 or 2 for none, few or many."""
    zero, one = np.divmod(np.arange(1 << 16), 256)
    odds = np.log((one + 0.4) / (zero + 0.4)).astype(np.float32)
    return odds, np.where(zero + one == 0, 0, np.where(zero + one < 4, 1, 2)).astype(np.uint8)


ODDS, SEEN = _lookup()


@dataclass
class Code:
    """Huffman paths: symbol s has nodes[at[s]:at[s+1]] and the bits taken there; ``depth`` is a node's class 0..2.

    Four levels of the tree share an anchor, the node at their top, and have places 1 .. 15 under it, so that the counters of
    four bits lie side by side in a table.
    """

    at: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    depth: np.ndarray

    def __post_init__(self):
        """Anchors and places follow from the paths, so they aren't sent along."""
        inside = np.arange(len(self.nodes)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.anchors = self.nodes[np.arange(len(self.nodes)) - inside % 4]
        place = np.ones(len(self.nodes), np.intp)
        for back in (3, 2, 1):
            step = np.flatnonzero(inside % 4 >= back)
            place[step] = 2 * place[step] + self.bits[step - back]
        self.places = place

    def __reduce__(self):
        return Code, (self.at, self.nodes, self.bits, self.depth)

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        """Every symbol gets a path; a count of zero counts as one."""
        n = max(len(counts), 2)
        heap = [(max(int(c), 1), i) for i, c in enumerate(counts)] + [(1, i) for i in range(len(counts), n)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        for inner in range(n, 2 * n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right], side[right] = inner, inner, 1
            heapq.heappush(heap, (a + b, inner))
        at, nodes, bits, level = [0], [], [], np.zeros(2 * n - 1, np.int64)
        for inner in range(2 * n - 3, n - 1, -1):
            level[inner] = level[parent[inner]] + 1
        for leaf in range(n):
            path, node = [], leaf
            while node != 2 * n - 2:
                path.append((parent[node] - n, side[node]))
                node = parent[node]
            path.reverse()
            nodes += [p[0] for p in path]
            bits += [p[1] for p in path]
            at.append(len(nodes))
        deep = level[n:]
        return cls(np.array(at), np.array(nodes, np.uint32), np.array(bits, np.uint8), np.where(deep < 4, 0, np.where(deep < 9, 1, 2)).astype(np.uint8))

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(path length of each symbol, places of its steps in the flat arrays) of all paths, one after the other."""
        length = self.at[symbols + 1] - self.at[symbols]
        total = np.cumsum(length)
        return length, np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[symbols] - total + length, length)


def slot(context: np.ndarray, anchor: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2**bits counters: a line of 16 by the context and the anchor, and the place in it."""
    x = (context ^ anchor) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    line = ((x * np.uint32(0xC2B2AE35)) >> np.uint32(36 - bits)).astype(np.intp)
    line <<= 4
    line |= place
    return line


def fold(*parts: np.ndarray) -> np.ndarray:
    """A 32-bit hash of integer columns."""
    x = np.full(len(parts[0]), 0x811C9DC5, np.uint32)
    for p in parts:
        x = (x ^ p.astype(np.uint32)) * np.uint32(0x01000193)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x5BD1E995)
    return x


def slots(code: Code, symbols: np.ndarray, contexts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(path lengths, nodes, bits, one array of table slots for each predictor)."""
    length, index = code.expand(symbols)
    take = lambda a: a.take(index, mode="clip")
    node, bit, anchor, place = take(code.nodes), take(code.bits), take(code.anchors) * np.uint32(0x9E3779B1), take(code.places)
    return length, node, bit, [node, *(slot(np.repeat(c, length), anchor, place, bits) for c in contexts)]


def packed(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts, halved together until both are under 256, as 16 bits."""
    pair = counts.reshape(-1, 2).astype(np.int64)
    most = pair.max(axis=1)
    shift = np.maximum(0, np.ceil(np.log2((most + 1) / 256))).astype(np.int64)
    return ((pair[:, 0] >> shift) << 8 | (pair[:, 1] >> shift)).astype(np.uint16)


class Mixer:
    """Weights and refinement for one code; ``learn`` changes them, ``odds`` doesn't."""

    def __init__(self, inputs: int, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = self.fresh(inputs) if weights is None else weights.astype(np.float32).reshape(GATES, inputs + 1)
        self.knots = np.linspace(-_SPAN, _SPAN, KNOTS).astype(np.float32)
        self.refine = np.tile(self.knots, (3, 1)) if refine is None else refine.astype(np.float32).reshape(3, KNOTS)
        self.square = np.full(self.weights.shape, 1e-4, np.float64)
        self.square2 = np.full(self.refine.shape, 1e-4, np.float64)
        self.used, self.used2 = np.zeros(GATES), np.zeros(self.refine.shape)  # bits that each gate and each knot has learnt from

    @staticmethod
    def fresh(inputs: int) -> np.ndarray:
        """A weighted mean of the predictors that have seen anything."""
        out = np.zeros((GATES, inputs + 1), np.float32)
        for gate in range(GATES):
            seen = [gate // 9 % 3, gate // 3 % 3, gate % 3][-inputs:]
            share = np.array([2] * (inputs - len(seen)) + [(0, 0.3, 1)[s] for s in seen], np.float32)
            out[gate, :inputs] = share / max(share.sum(), 1)
        return out

    @staticmethod
    def inputs(tables: list[np.ndarray], where: list[np.ndarray], depth: np.ndarray, own: np.ndarray | None = None, taught: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each predictor with a constant last, gate). ``own``: bits whose own count is taken out first, where ``taught``."""
        x = np.empty((len(tables) + 1, len(depth)), np.float32)
        gate = depth.astype(np.intp)
        for k, (table, at) in enumerate(zip(tables, where)):
            pair = table.take(at, mode="clip")
            if own is not None:
                step = np.where(own, np.uint16(1), np.uint16(256))
                has = np.where(own, pair & np.uint16(255), pair >> np.uint16(8)) > 0
                has = has if taught is None else has & taught
                pair = pair - step * has
            pair = pair.astype(np.intp)
            ODDS.take(pair, out=x[k], mode="clip")
            if k >= len(tables) - 3:
                gate *= 3
                gate += SEEN.take(pair, mode="clip")
        x[-1] = 0.3
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(len(gate), np.float32)
        columns = np.ascontiguousarray(self.weights.T)
        for k in range(len(x)):
            w = columns[k].take(gate, mode="clip")
            if extra is not None:
                w += extra[k]
            w *= x[k]
            total += w
        return np.clip(total, -_SPAN + 0.01, _SPAN - 0.01)

    def refined(self, total: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean of the mixed and the refined log odds, lower knot, share of the upper knot)."""
        place = (total + np.float32(_SPAN)) * np.float32((KNOTS - 1) / (2 * _SPAN))
        low = place.astype(np.intp)
        part = place - low.astype(np.float32)
        at = low + depth.astype(np.intp) * KNOTS
        flat = self.refine.ravel()
        left = flat.take(at, mode="clip")
        return (total + left + (flat.take(at + 1, mode="clip") - left) * part) * np.float32(0.5), at, part

    def learn(self, x: np.ndarray, gate: np.ndarray, depth: np.ndarray, bit: np.ndarray, rate: float = 0.05) -> None:
        """One gradient step over these bits for the weights and one for the refinement."""
        total = self.mixed(x, gate)
        err = bit - 1 / (1 + np.exp(-total))
        for k in range(len(x)):
            g = np.bincount(gate, err * x[k], GATES)
            self.square[:, k] += g * g
            self.weights[:, k] += rate * g / np.sqrt(self.square[:, k])
        self.used += np.bincount(gate, minlength=GATES)
        odds, at, part = self.refined(total, depth)
        err = bit - 1 / (1 + np.exp(-odds))
        g = (np.bincount(at, err * (1 - part), 3 * KNOTS) + np.bincount(at + 1, err * part, 3 * KNOTS + 1)[: 3 * KNOTS]).reshape(3, KNOTS)
        self.used2 += (np.bincount(at, minlength=3 * KNOTS) + np.bincount(at + 1, minlength=3 * KNOTS + 1)[: 3 * KNOTS]).reshape(3, KNOTS)
        self.square2 += g * g
        self.refine += rate * g / np.sqrt(self.square2)

    def state(self) -> np.ndarray:
        """Weights and refinement, each times the bits it has learnt from, and these numbers; states of several mixers may be added."""
        return np.concatenate([x.ravel() for x in (self.weights * self.used[:, None], self.used, self.refine * self.used2, self.used2)])

    def take(self, total: np.ndarray) -> Mixer:
        """The means of added states; what no mixer has learnt stays as it is."""
        sums, used, refined, used2 = np.split(total, np.cumsum([self.weights.size, GATES, self.refine.size]))
        sums, refined, used2 = sums.reshape(self.weights.shape), refined.reshape(self.refine.shape), used2.reshape(self.refine.shape)
        self.weights = np.where(used[:, None] > 0, sums / np.maximum(used, 1)[:, None], self.weights).astype(np.float32)
        self.refine = np.where(used2 > 0, refined / np.maximum(used2, 1), self.refine).astype(np.float32)
        return self


def log2_likelihood(odds: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """log2 of the probability given to each bit."""
    sign = np.float32(1) - np.float32(2) * bit.astype(np.float32)
    return -np.log2(np.float32(1) + np.exp(odds * sign))
