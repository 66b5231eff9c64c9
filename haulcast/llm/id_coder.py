"""Range coding of token ids under adaptively mixed predictions of order 0 to 2.

A block of ids is one lane; many lanes advance together, one id a step, each
with models of its own that start empty. Order 2 and order 1 each predict the
id that last followed the same two ids or the same id. An adaptive gate, one
set of counts for each pair of confidences, mixes them with order 0: it gives the
probability that order 2 is right, that order 1 is, or that neither is. Then order 0
predicts the id in digits of 4 bits, each from the counts of the digits above.
Gate and digits are symbols of one range coder with 48-bit intervals and 16-bit
output. Everything is integer arithmetic, so a block decodes to the same
ids on any machine.

Counts are kept as rows of running sums, the last of which is the total.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WORD, LOW_BITS = U(16), U(32)
#: Length of a settled interval. The limits below keep a gate and two digits coded after it above 0.
LEAST, WIDEST = U(1 << 32), U((1 << 48) - 1)

CONTEXT_BITS = 11
CONFIDENT = 3
GATES = 2 * (CONFIDENT + 1) ** 2
GATE_STEP, GATE_LIMIT = 16, 1 << 9
DIGIT_STEP, DIGIT_LIMIT = 24, 1 << 11
DIGIT_ROWS = 1 << 10
#: Predictions are stored as id + 1, with their confidence in the bits above.
ID_SHIFT, ID_MASK = np.uint32(24), np.uint32((1 << 24) - 1)
TRUST = np.uint32(1 << 24)
ONE, TWO = np.uint32(1), np.uint32(2)


class Counts:
    """Adaptive counts of the symbols 0 to ``width`` - 1 in many contexts, as running sums.

    What is kept starts at zero, so that contexts which never occur take no memory; every symbol counts one more than that.
    """

    def __init__(self, contexts: int, width: int, step: int, limit: int) -> None:
        self.kept = np.zeros((contexts, width), np.uint16)
        # A row is moved as one value of its bytes: much faster than as a list of numbers.
        self.whole = self.kept.view(f"V{2 * width}").ravel()
        self.least = np.arange(1, width + 1, dtype=np.uint16)
        self.steps = (step * np.tri(width, dtype=np.uint16)).T.copy()
        self.limit = limit

    def look(self, context: np.ndarray) -> np.ndarray:
        return self.kept.take(context, 0, mode="clip")

    def add(self, context: np.ndarray, rows: np.ndarray, symbols: np.ndarray) -> None:
        """Count ``symbols``; ``rows`` are the kept rows of ``context``, which are all different."""
        rows += self.steps.take(symbols, 0, mode="clip")
        full = np.flatnonzero(rows[:, -1] > self.limit)
        if len(full):
            rows[full] >>= 1
        self.whole.put(context, rows.view(self.whole.dtype).ravel(), mode="clip")


class Encoder:
    """Narrows one interval per lane and writes its settled words.

    A lane's interval is ``range`` long, from ``low`` on; a carry out of ``low`` is added to the words already written.
    """

    def __init__(self, lanes: int, ids: int) -> None:
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, WIDEST)
        self.first = np.arange(lanes) * (4 * ids + 5)
        self.words = np.zeros(lanes * (4 * ids + 5), np.uint16)
        #: Where each lane writes (or reads) its next word; one word is left free before the first.
        self.at = self.first + 1
        self.lane = np.arange(lanes)

    def part(self, index) -> Encoder:
        """The coder of some lanes; words and their places are shared."""
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.low, out.range, out.lane = self.low[index], self.range[index], self.lane[index]
        return out

    def back(self, index, part: Encoder) -> None:
        self.low[index], self.range[index] = part.low, part.range

    def code(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        flat, width = rows.ravel(), rows.shape[1]
        at = np.arange(0, len(flat), width) + symbols
        below = flat.take(at - 1, mode="clip") * (symbols > 0)
        self.range //= rows[:, -1]
        self.low += self.range * below
        self.range *= flat.take(at, mode="clip") - below
        return symbols

    def settle(self) -> None:
        """Move words out of, or into, lanes whose interval has become narrow."""
        lanes = np.flatnonzero(self.range < LEAST)
        while len(lanes):
            self._move(lanes)
            wide = self.range[lanes] << WORD
            self.range[lanes] = wide
            lanes = lanes[wide < LEAST]

    def _move(self, lanes: np.ndarray) -> None:
        lane, low = self.lane[lanes], self.low[lanes]
        at = self.at[lane]
        word = low >> LOW_BITS
        self.words[at] = word  # without the carry, which is the bit above
        self.at[lane] = at + 1
        self.low[lanes] = (low & (LEAST - U(1))) << WORD
        at = at[word > 0xFFFF]
        while len(at):
            at = at - 1
            self.words[at] += 1
            at = at[self.words[at] == 0]

    def payloads(self) -> list[bytes]:
        for _ in range(3):
            self._move(np.arange(len(self.low)))
        return [self.words[a + 1 : b].astype("<u2").tobytes() for a, b in zip(self.first, self.at)]


def _how_many(passed: np.ndarray) -> np.ndarray:
    """True values in each row of 4 or 16."""
    if passed.shape[1] == 4:
        return np.bitwise_count(passed.view(np.uint32).ravel()).astype(np.int64)
    halves = np.bitwise_count(passed.view(np.uint64))
    return (halves[:, 0] + halves[:, 1]).astype(np.int64)


class Decoder(Encoder):
    """Follows the encoder's intervals and finds the symbols; ``low`` is how far the code lies inside the interval."""

    def __init__(self, payloads: list[bytes]) -> None:
        lanes = len(payloads)
        size = max(map(len, payloads)) // 2 + 8
        self.words = np.zeros(lanes * size, np.uint16)
        self.at = np.arange(lanes) * size
        for at, payload in zip(self.at, payloads):
            self.words[at : at + len(payload) // 2] = np.frombuffer(payload, "<u2")
        self.lane = np.arange(lanes)
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, WIDEST)
        for _ in range(3):
            self._move(self.lane)

    def code(self, rows: np.ndarray, symbols: np.ndarray | None) -> np.ndarray:
        total = rows[:, -1]
        self.range //= total
        # A damaged block may point past the total; its checksum tells.
        place = np.minimum(self.low // self.range, total - U(1)).astype(np.uint16)
        found = _how_many(rows <= place[:, None])
        flat = rows.ravel()
        at = np.arange(0, len(flat), rows.shape[1]) + found
        below = flat.take(at - 1, mode="clip") * (found > 0)
        self.low -= self.range * below
        self.range *= flat.take(at, mode="clip") - below
        return found

    def _move(self, lanes: np.ndarray) -> None:
        lane = self.lane[lanes]
        at = self.at[lane]
        self.low[lanes] = (self.low[lanes] << WORD) | self.words.take(at, mode="clip")
        self.at[lane] = at + 1


class Guesses:
    """The id that last followed each context, with a confidence of 0 (none yet) to CONFIDENT."""

    def __init__(self, lanes: int) -> None:
        self.slots = np.zeros(lanes << CONTEXT_BITS, np.uint32)
        self.base = np.arange(lanes, dtype=np.int64) << CONTEXT_BITS

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, guessed id + 1 and confidence."""
        slot = self.base[: len(key)] + (key * np.uint32(0x9E3779B1) >> np.uint32(32 - CONTEXT_BITS))
        held = self.slots.take(slot, mode="clip")
        return slot, held & ID_MASK, held >> ID_SHIFT

    def learn(self, slot: np.ndarray, guess: np.ndarray, trust: np.ndarray, ids: np.ndarray) -> None:
        held = guess | (trust << ID_SHIFT)
        right = held + (trust < CONFIDENT) * TRUST
        self.slots[slot] = np.where(guess == ids, right, np.where(trust > 1, held - TRUST, ids | TRUST))


def _run(coder: Encoder, lengths: np.ndarray, size: int, ids: np.ndarray | None) -> np.ndarray:
    """Code all lanes; ``lengths`` fall. ``ids`` has one row per step, none where they are to be found."""
    lanes, steps = len(lengths), int(lengths[0])
    n_digits = max(1, -(-(size - 1).bit_length() // 4))
    gates = Counts(lanes * GATES, 4, GATE_STEP, GATE_LIMIT)
    # How many values the digits above each digit can have; those of one remainder share a row.
    above = [min(-(-size // 16 ** (n_digits - k)), DIGIT_ROWS) for k in range(n_digits)]
    digits = [Counts(lanes * n, 16, DIGIT_STEP, DIGIT_LIMIT) for n in above]
    one_order, two_orders = Guesses(lanes), Guesses(lanes)
    out = np.zeros((steps, lanes), np.uint32) if ids is None else ids
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    everyone, first_gate = coder, np.arange(lanes) * GATES
    for t in range(steps):
        m = int(active[t])
        if m < len(coder.low):
            everyone.back(slice(len(coder.low)), coder)
            coder, one, two, first_gate = everyone.part(slice(m)), one[:m], two[:m], first_gate[:m]
        s1, g1, c1 = one_order.look(one)
        s2, g2, c2 = two_orders.look(one * np.uint32(0x85EBCA6B) + two)
        context = first_gate + ((c2 << TWO) + c1 + ((g1 == g2) << np.uint32(4)))
        rows = gates.look(context)
        token = known = None
        if ids is not None:
            token = ids[t, :m] + ONE
            known = ((token != g2) * (ONE + (token != g1))).astype(np.int64)
        gate = coder.code(rows + gates.least, known)
        gates.add(context, rows, gate)
        missed = np.flatnonzero(gate == 2)
        part = coder.part(missed)
        whole = None if token is None else token[missed].astype(np.int64) - 1
        value = np.zeros(len(missed), np.int64)
        for k, counts in enumerate(digits):
            context = missed * above[k] + value % above[k]
            rows = counts.look(context)
            digit = part.code(rows + counts.least, None if whole is None else (whole >> 4 * (n_digits - 1 - k)) & 15)
            counts.add(context, rows, digit)
            value = (value << 4) | digit
            if k % 2 and k + 1 < n_digits:
                part.settle()
        coder.back(missed, part)
        coder.settle()
        if token is None:
            token = np.where(gate == 0, g2, g1)
            token[missed] = value + 1
            out[t, :m] = token - ONE
        one_order.learn(s1, g1, c1, token)
        two_orders.learn(s2, g2, c2, token)
        two, one = one, token
    everyone.back(slice(len(coder.low)), coder)
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, size: int) -> list[bytes]:
    """Payload of each lane. ``ids`` has a row per step and a column per lane, ``lengths`` fall, ids are below ``size``."""
    coder = Encoder(len(lengths), int(lengths[0]))
    _run(coder, lengths, size, ids)
    return coder.payloads()


def decode(payloads: list[bytes], lengths: np.ndarray, size: int) -> np.ndarray:
    """The ids again, one row per step."""
    return _run(Decoder(payloads), lengths, size, None)
