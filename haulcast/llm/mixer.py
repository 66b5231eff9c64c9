"""Logistic mixing of hashed-context bit predictors over the bytes of units.

A unit is the bytes up to and including a separator (or the end of the text), so
its end is known as soon as it is read. Each byte is a path in a binary code
tree; every step of a path is a bit that several predictors guess, each from
counts under a hash of the tree node and its own context: the unit so far with
the previous word, the unit so far, its last three, two, or one bytes. Their
guesses are combined by weights that the node selects, and the result is
refined by a table of what happened at like guesses. Each bit's two
probabilities sum to one, so those of all texts do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from haulcast.llm.words import _tables, mix

END = 0xFF
#: Hash bits of the predictors' tables, in the order of ``_contexts``.
TABLE_BITS = (20, 20, 20, 18, 18)
PREDICTORS = len(TABLE_BITS)
#: Classes of previous words.
PREVIOUS = 64
NODES = 256
STEPS = 33
LIMIT = 8.0
#: Bytes taken at once.
BLOCK = 1 << 17
LEARN = 0.4
START = 0.3


@dataclass
class Code:
    """A binary tree built for the frequencies of the 256 bytes, its leaves numbered from left to right.

    Below a node lie the leaves ``spans[node]``: from the first number to the second by a zero, from there to the third by a one.
    """

    length: np.ndarray
    rank: np.ndarray
    spans: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        heap = [(float(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        below: list[tuple[int, int]] = []
        size = [1] * 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            made = len(size)
            below.append((a[2], b[2]))
            size.append(size[a[2]] + size[b[2]])
            heapq.heappush(heap, (a[0] + b[0], made, made))
        depth, first = [0] * len(size), [0] * len(size)
        spans = np.zeros((len(below), 3), np.int64)
        for node in range(len(below) - 1, -1, -1):
            zero, one = below[node]
            at = 256 + node
            depth[zero] = depth[one] = depth[at] + 1
            first[zero], first[one] = first[at], first[at] + size[zero]
            spans[node] = first[zero], first[one], first[at] + size[at]
        return Code(np.array(depth[:256], np.int64), np.array(first[:256], np.uint8), spans)


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of units of about ``limit`` bytes."""
    at = 0
    while at < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield at, end
        at = end


def _contexts(codes: np.ndarray, offsets: np.ndarray, previous: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash per byte and predictor."""
    size = np.diff(offsets)
    start = np.repeat(offsets[:-1], size)
    place = np.arange(len(codes)) - start
    t = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(t.values[codes] * t.up[: len(codes)], out=sums[1:])
    prefix = mix((sums[:-1] - sums[start]) * t.down[start] + place.astype(np.uint64))
    back = []
    for j in (1, 2, 3):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[j:] = codes[:-j] if j < len(codes) else 0
        shifted[place < j] = 0
        back.append(shifted)
    two = back[0] | back[1] << np.uint64(8)
    with_word = prefix ^ np.repeat(mix(previous.astype(np.uint64) + np.uint64(1)), size)
    first = back[0] | np.minimum(place, 3).astype(np.uint64) << np.uint64(8)
    return [
        (with_word >> np.uint64(32)).astype(np.uint32),
        prefix.astype(np.uint32),
        (mix(two | back[2] << np.uint64(16)) >> np.uint64(32)).astype(np.uint32),
        (mix(two + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32),
        (mix(first + np.uint64(1 << 41)) >> np.uint64(32)).astype(np.uint32),
    ]


@dataclass
class Bits:
    """Steps of all bytes of a block, those of a tree node together: node, outcome and table slot of each predictor.

    The bytes lie in the order of the tree's leaves, ``order``, so those below a node are a piece of it, ``low:high``.
    """

    node: np.ndarray
    bit: np.ndarray
    order: np.ndarray
    used: np.ndarray
    low: np.ndarray
    high: np.ndarray
    starts: np.ndarray
    slots: list[np.ndarray]

    @staticmethod
    def of(code: Code, codes: np.ndarray, offsets: np.ndarray, previous: np.ndarray) -> Bits:
        rank = code.rank[codes]
        order = np.argsort(rank, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(rank, minlength=256)))
        low, middle, high = ends[code.spans].T
        used = np.flatnonzero(low < high)
        low, middle, high = low[used], middle[used], high[used]
        size = high - low
        outcomes = np.tile(np.array([0, 1], np.uint8), len(used))
        bit = np.repeat(outcomes, np.stack([middle - low, high - middle], axis=1).ravel())
        bits = Bits(np.repeat(used, size), bit, order, used, low, high, np.cumsum(size) - size, [])
        salt = np.repeat(used.astype(np.uint32) * np.uint32(0x9E3779B1), size)
        for context, width in zip(_contexts(codes, offsets, previous), TABLE_BITS):
            # Contexts are well mixed already: the node moves each to a place of its own.
            slot = bits.of_bytes(context)
            slot += salt
            slot >>= np.uint32(32 - width)
            bits.slots.append(slot)
        return bits

    def of_bytes(self, values: np.ndarray) -> np.ndarray:
        """For each step the value of its byte."""
        values = values[self.order]
        return np.concatenate([values[a:b] for a, b in zip(self.low.tolist(), self.high.tolist())])

    def of_nodes(self, values: np.ndarray) -> np.ndarray:
        """For each step the value of its node."""
        out = np.empty(len(self.node), values.dtype)
        for at, size, value in zip(self.starts.tolist(), (self.high - self.low).tolist(), values[self.used]):
            out[at : at + size] = value
        return out

    def by_node(self, values: np.ndarray) -> np.ndarray:
        """Sums over the steps of each node."""
        out = np.zeros(NODES)
        out[self.used] = np.add.reduceat(values, self.starts)
        return out

    def by_byte(self, values: np.ndarray) -> np.ndarray:
        """Sums over the steps of each byte."""
        sums = np.zeros(len(self.order))
        for a, b, at in zip(self.low.tolist(), self.high.tolist(), self.starts.tolist()):
            sums[a:b] += values[at : at + b - a]
        out = np.empty_like(sums)
        out[self.order] = sums
        return out


@dataclass
class Counts:
    """How often each slot saw each outcome: ``2 * slot + bit``."""

    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(2 << b, np.int32) for b in TABLE_BITS])

    def add(self, bits: Bits, weight: np.ndarray) -> None:
        weight = weight.astype(np.int32)
        for table, slot in zip(self.tables, bits.slots):
            place = slot.astype(np.intp)
            place <<= 1
            place |= bits.bit
            if len(table) <= 2 * len(slot):
                table += np.bincount(place, weight, len(table)).astype(np.int32)
            else:
                np.add.at(table, place, weight)

    def guesses(self) -> list[np.ndarray]:
        """Log odds of a one in each slot."""
        return [np.log((t[1::2] + 0.4) / (t[::2] + 0.4)).clip(-LIMIT, LIMIT).astype(np.float32) for t in self.tables]

    def guess(self, bits: Bits) -> np.ndarray:
        """The same for the slots of some bits only."""
        out = np.empty((PREDICTORS, len(bits.node)), np.float32)
        for k, (t, slot) in enumerate(zip(self.tables, bits.slots)):
            if len(t) <= 2 * len(slot):
                # Fewer slots than steps: the odds of each slot are worked out once.
                whole = t.astype(np.float32)
                whole += np.float32(0.4)
                np.log(whole[1::2] / whole[::2]).take(slot, mode="clip", out=out[k])
                continue
            # Both counts of a slot are fetched at once, as one number of eight bytes.
            both = t.view(np.int64).take(slot, mode="clip").view(t.dtype).astype(np.float32)
            both += np.float32(0.4)
            np.log(np.divide(both[1::2], both[::2], out=out[k]), out=out[k])
        return out.clip(-LIMIT, LIMIT, out=out)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Weights by node, and the refinement table by node and step of the mixed guess."""

    weights: np.ndarray = field(default_factory=lambda: np.full((PREDICTORS, NODES), START, np.float32))
    ones: np.ndarray = field(default_factory=lambda: 8.0 * _start_of_refinement())
    seen: np.ndarray = field(default_factory=lambda: np.full(NODES * STEPS, 8.0))
    total: float = 0.0

    def mixed(self, bits: Bits, guess: np.ndarray | list[np.ndarray]) -> np.ndarray:
        out = bits.of_nodes(self.weights[0]) * guess[0]
        for k in range(1, PREDICTORS):
            out += bits.of_nodes(self.weights[k]) * guess[k]
        return np.clip(out, -LIMIT, LIMIT, out=out)

    def learn(self, bits: Bits, guess: np.ndarray, weight: np.ndarray) -> None:
        """One online step: move the weights along the gradient of the bits' cost, and note what happened."""
        dot = self.mixed(bits, guess)
        error = (bits.bit - _squash(dot)) * weight
        mass = bits.by_node(weight) + 30.0
        for k in range(PREDICTORS):
            step = bits.by_node(error * guess[k]) / mass
            self.weights[k] += (LEARN * step).astype(np.float32)
        cell, part = _cells(bits.node, dot)
        # The outcomes' cells lie one table after the other, so that one pass counts both.
        at = cell + bits.bit * np.intp(len(self.seen))
        whole = np.bincount(at, weight, 2 * len(self.seen))
        upper = np.bincount(at, part * weight, 2 * len(self.seen))
        whole -= upper
        whole[1:] += upper[:-1]
        zeros, ones = whole.reshape(2, -1)
        self.seen += zeros + ones
        self.ones += ones
        self.total += float(weight.sum())


def _cells(node: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (dot + np.float32(LIMIT)) * np.float32((STEPS - 1) / (2 * LIMIT))
    low = np.minimum(at.astype(np.int32), STEPS - 2)
    return node * STEPS + low, at - low


def _start_of_refinement() -> np.ndarray:
    return np.tile(_squash(np.linspace(-LIMIT, LIMIT, STEPS)), NODES)


@dataclass
class Model:
    """A trained model, read only."""

    code: Code
    guesses: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    def log10(self, codes: np.ndarray, offsets: np.ndarray, previous: np.ndarray) -> np.ndarray:
        """log10 probability of each unit after a word of class ``previous``."""
        out = np.zeros(len(offsets) - 1)
        mixer = Mixer(self.weights, np.zeros(0), np.zeros(0))
        for low, high in blocks(offsets):
            first, last = offsets[low], offsets[high]
            inside = offsets[low : high + 1] - first
            bits = Bits.of(self.code, codes[first:last], inside, previous[low:high])
            dot = mixer.mixed(bits, [table.take(slot, mode="clip") for table, slot in zip(self.guesses, bits.slots)])
            cell, part = _cells(bits.node, dot)
            refined = self.refined.take(cell, mode="clip") * (1 - part) + self.refined.take(cell + 1, mode="clip") * part
            chance = ((_squash(dot) + refined) / 2).clip(1e-6, 1 - 1e-6)
            cost = np.log(np.where(bits.bit == 1, chance, 1 - chance))
            sums = np.append(0.0, np.cumsum(bits.by_byte(cost)))
            out[low:high] = np.diff(sums[inside]) / np.log(10)
        return out
