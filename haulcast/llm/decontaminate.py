"""Operator 2: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus give IDF weights.
2. All passages of ``PASSAGE`` words, as unit TF-IDF rows, form a matrix A. Each task
   adds its share of ``A'A R`` for a random R; the sums are taken in Spark, block by
   block, and the randomised (Nystrom) decomposition of that small sketch gives
   the leading right singular vectors: the latent space.
3. Every window of ``WINDOW`` words, taken at each ``STRIDE``-th word, is projected
   and compared by cosine with windows all along the benchmark items. A candidate
   shares ``KNOWN`` of the window's IDF weight with the item; a window that does not
   share as much with the whole benchmark is left out before the projection.
4. Around each candidate the longest common subsequence of item and document is
   taken. ``SURE`` of the item's words in order is a leak; from ``LIKELY`` on it is one
   if the answer (the item's last ``ANSWER`` words) is there too: a paraphrase. A
   run of ``RUN`` of the item's words without a break that is more than half of it
   is a leak too, with or without the answer.

Documents never leave their task, and no pair of rows is shuffled: items are
the stated query set and go in blocks of ``BLOCK`` to all rows. The driver holds
a block of items and sketches of fixed size.

Defined cases: null and empty texts and texts of unrelated words are clean; an
empty or all-null benchmark leaves all clean; of several items the one with the
highest share is named, then the smallest id; items without words are skipped;
repeated rows are judged alike; texts are searched whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.tables import col, only
from haulcast.llm.words import Words, mix, steps, words_of

#: Hashed words that have a frequency of their own, and that are columns of A.
IDF_BITS = 18
COLUMNS_BITS = 14
RANK = 24
PASSAGE = 48
WINDOW = 12
STRIDE = 4
#: The item's windows start at each so many words: a document's window is at most one word off one of them.
ITEM_STRIDE = 3
#: Least share of a window's IDF that lies on words of the item it is compared with.
KNOWN = 0.5
#: Least cosine of a candidate.
COSINE = 0.7
LIKELY = 0.6
SURE = 0.8
ANSWER = 6
RUN = 13
#: Items sent to the tasks at once.
BLOCK = 2000
#: Words of the item's length that the document may have more around the window.
SLACK = 0.5
PARTS = 64

Adder = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


def summed(df: DataFrame, add: Adder, size: int) -> np.ndarray:
    """Sum of the vectors that ``add`` makes of each partition, added up in Spark by parts of the vector.

    Sent as doubles: counts are exact up to 2**53.
    """
    cut = np.linspace(0, size, PARTS + 1).astype(int)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = add(batches)
        for part in range(PARTS):
            piece = vector[cut[part] : cut[part + 1]]
            if piece.any():
                yield _part(part, piece)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("vector").to_pylist()):
                piece = np.frombuffer(blob)
                sums[part] = sums[part] + piece if part in sums else piece
        for part, piece in sums.items():
            yield _part(part, piece)

    out = np.zeros(size)
    parts = df.mapInArrow(make, "part int, vector binary").repartition(PARTS, "part").mapInArrow(total, "part int, vector binary")
    for row in parts.collect():
        out[cut[row["part"]] : cut[row["part"] + 1]] = np.frombuffer(row["vector"])
    return out


def _part(part: int, piece: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([piece.astype(np.float64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "vector"])


def _words(column: pa.Array) -> Words:
    """Words without regard to case, in any alphabet: a shouted copy is a copy."""
    return words_of(pc.utf8_lower(column))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """IDF of each hashed word over all words of frame (text).

    Passages are short and seldom repeat a word, so each occurrence counts as a passage that has it.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros((1 << IDF_BITS) + 1)
        for batch in steps(batches, "text"):
            words = _words(batch.column("text"))
            seen[:-1] += np.bincount(_slots(words.hash, IDF_BITS), minlength=1 << IDF_BITS)
            seen[-1] += len(words.hash) / PASSAGE
        return seen

    seen = summed(texts, add, (1 << IDF_BITS) + 1)
    return np.log((seen[-1] + 1) / (seen[:-1] + 1)).clip(0.05).astype(np.float32)


def _random_directions() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((1 << COLUMNS_BITS, RANK), np.float32)


def latent_space(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of all passages, columns by rank."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        directions = _random_directions()
        total = np.zeros((RANK, 1 << COLUMNS_BITS), np.float64)
        for batch in steps(batches, "text", 1 << 20):
            words = _words(batch.column("text"))
            if not len(words.hash):
                continue
            weight, column = idf[_slots(words.hash, IDF_BITS)], _slots(mix(words.hash), COLUMNS_BITS)
            place = np.arange(len(column)) - words.bounds[words.doc]
            new = np.flatnonzero(place % PASSAGE == 0)
            row = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(column))))
            weight = weight / np.sqrt(np.add.reduceat(weight * weight, new))[row]
            image = directions[column]
            image *= weight[:, None]
            image = np.ascontiguousarray(np.add.reduceat(image, new, axis=0).T, np.float64)
            for j in range(RANK):
                total[j] += np.bincount(column, image[j][row] * weight, 1 << COLUMNS_BITS)
        return total.T.ravel()

    sketch = summed(texts, add, RANK << COLUMNS_BITS).reshape(1 << COLUMNS_BITS, RANK)
    # Nystrom: A'A is near sketch @ inverse(core) @ sketch', with core = R' A'A R.
    core = _random_directions().T.astype(np.float64) @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    used = values > max(values.max(), 0) * 1e-6
    half = sketch @ (vectors[:, used] / np.sqrt(values[used])) if used.any() else np.zeros((1 << COLUMNS_BITS, 1))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    return (left[:, singular > 0]).astype(np.float32) if (singular > 0).any() else left[:, :1].astype(np.float32)


def _offsets(last: int) -> list[int]:
    """Each ITEM_STRIDE-th place up to ``last``, and that."""
    return sorted({*range(0, last, ITEM_STRIDE), max(last, 0)})


class Items:
    """A block of benchmark items, ready for the search."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, space: np.ndarray) -> None:
        self.idf, self.space = idf, space
        words = _words(pa.array([text for _, text in rows], pa.string()))
        bounds = words.bounds
        self.ids = [i for i, _ in rows]
        self.words = [words.hash[bounds[i] : bounds[i + 1]].tolist() for i in range(len(rows))]
        self.known = np.unique(words.hash)
        self.slots = np.zeros(1 << IDF_BITS, bool)
        self.slots[_slots(self.known, IDF_BITS)] = True
        at = [
            (k, bounds[k] + i, min(bounds[k] + i + WINDOW, bounds[k + 1]))
            for k in range(len(rows))
            for i in _offsets(int(bounds[k + 1] - bounds[k]) - WINDOW)
            if bounds[k + 1] > bounds[k]
        ]
        self.owner = np.array([a[0] for a in at], np.int64)
        self.first = np.array([a[1] - bounds[a[0]] for a in at], np.int64)
        start, end = (np.array([a[i] for a in at], np.int64) for i in (1, 2))
        self.vectors = latent(words, start, end, idf, space)
        self.masks = [_masks(w) for w in self.words]
        self.runs = [_runs(w, run_of(len(w))) for w in self.words]
        self.own = np.unique(_owned(words.hash, words.doc))

    def candidates(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item, window's first word) of likely leaks in a batch."""
        n = len(words.hash)
        if not n or not len(self.owner):
            return
        weight = self.idf[_slots(words.hash, IDF_BITS)].astype(np.float64)
        # Few words share a slot with a word of the benchmark; only those are looked up.
        maybe = np.flatnonzero(self.slots[_slots(words.hash, IDF_BITS)])
        near = np.searchsorted(self.known, words.hash[maybe])
        near[near == len(self.known)] = 0
        sure = maybe[self.known[near] == words.hash[maybe]]
        held_weight = np.zeros(n)
        held_weight[sure] = weight[sure]
        known = np.append(0.0, np.cumsum(held_weight))
        mass = np.append(0.0, np.cumsum(weight))
        bounds = words.bounds
        place = np.arange(n) - bounds[words.doc]
        room = bounds[words.doc + 1] - np.arange(n)
        start = np.flatnonzero((place % STRIDE == 0) & ((room >= WINDOW) | (place == 0)))
        end = np.minimum(start + WINDOW, bounds[words.doc[start] + 1])
        held = known[end] - known[start] >= KNOWN * (mass[end] - mass[start])
        start, end = start[held], end[held]
        for low in range(0, len(start), 4096):
            s, e = start[low : low + 4096], end[low : low + 4096]
            cosine = latent(words, s, e, self.idf, self.space) @ self.vectors.T
            at, query = np.divmod(np.flatnonzero(cosine >= COSINE), cosine.shape[1])
            pairs = np.unique(at * np.int64(len(self.ids)) + self.owner[query])
            at, item = np.divmod(pairs, len(self.ids))
            shared = self._shared(words.hash, weight, s[at], e[at], item)
            for k in np.flatnonzero(shared >= KNOWN * (mass[e[at]] - mass[s[at]])).tolist():
                yield int(words.doc[s[at[k]]]), int(item[k]), int(s[at[k]])

    def _shared(
        self, hashes: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray
    ) -> np.ndarray:
        """Weight of each window's words that its item has too."""
        place = start[:, None] + np.arange(WINDOW)
        inside = place < end[:, None]
        place = np.minimum(place, len(hashes) - 1)
        wanted = _owned(hashes[place], item[:, None])
        near = np.searchsorted(self.own, wanted)
        near[near == len(self.own)] = 0
        return np.where(inside & (self.own[near] == wanted), weight[place], 0.0).sum(axis=1)

    def judge(self, words: Words) -> dict[int, tuple[float, int]]:
        """The best leak (share, item id) of each document that has one."""
        found: dict[int, tuple[float, int]] = {}
        values, bounds = words.hash, words.bounds
        met: dict[tuple[int, int], int] = {}
        for doc, item, place in self.candidates(words):
            size = len(self.words[item])
            # The region around a window half an item back holds all that this one's would, copies included.
            if place - met.get((doc, item), -size) <= size // 2:
                continue
            met[doc, item] = place
            reach = int(size * (1 + SLACK))
            low, high = max(bounds[doc], place - reach), min(bounds[doc + 1], place + WINDOW + reach)
            region = values[low:high].tolist()
            # No subsequence is longer than the words both have.
            there = set(region)
            if sum(w in there for w in self.words[item]) < min(LIKELY * size, run_of(size)):
                continue
            share = common_subsequence(self.masks[item], size, region) / size
            likely = share >= SURE or (share >= LIKELY and self.answered(item, region))
            if not likely and self.runs[item].isdisjoint(_runs(region, run_of(size))):
                continue
            if doc not in found or (share, -self.ids[item]) > (found[doc][0], -found[doc][1]):
                found[doc] = (share, self.ids[item])
        return found

    def answered(self, item: int, region: list[int]) -> bool:
        """Most of the item's last words stand in the region, in order."""
        answer = self.words[item][-ANSWER:]
        return common_subsequence(_masks(answer), len(answer), region) >= SURE * len(answer)


def run_of(size: int) -> int:
    """Words without a break that make a leak of an item of ``size`` words."""
    return min(max(RUN, size // 2 + 1), size)


def _runs(words: list[int], size: int) -> set[tuple[int, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _owned(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
    return hashes ^ mix(np.asarray(item) + 1)


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | (1 << i)
    return out


def common_subsequence(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    row = 0
    for word in other:
        mask = masks.get(word)
        if mask:
            joined = row | mask
            row = joined & ~(joined - ((row << 1) | 1))
    return (row & ((1 << size) - 1)).bit_count()


def latent(words: Words, start: np.ndarray, end: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space of the spans of at most WINDOW words."""
    if not len(start):
        return np.zeros((0, space.shape[1]), np.float32)
    at = np.minimum(start[:, None] + np.arange(WINDOW), len(words.hash) - 1)
    hashes = words.hash[at]
    weight = np.where(start[:, None] + np.arange(WINDOW) < end[:, None], idf[_slots(hashes, IDF_BITS)], np.float32(0))
    out = np.einsum("ij,ijk->ik", weight, space[_slots(mix(hashes.ravel()), COLUMNS_BITS)].reshape(*at.shape, -1))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12).astype(np.float32)


def find_leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``df`` with ``contaminated``, ``leaked_item`` and ``leaked_share`` (of the item's words, in order).

    Columns of these names in ``df`` are replaced.
    """
    out = df.drop("contaminated", "leaked_item", "leaked_share")
    texts = only(df, text=text)
    idf = inverse_frequencies(texts)
    space = latent_space(texts, idf)
    added = [F.lit(None).cast("long").alias("leaked_item"), F.lit(None).cast("double").alias("leaked_share")]
    out = out.select("*", *added)
    for block in _blocks(only(benchmark, item=item, text=item_text)):
        out = _search(out, text, Items(block, idf, space))
    return out.withColumn("contaminated", F.col("leaked_item").isNotNull())


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items with words, BLOCK at a time: the driver never holds more."""
    block: list[tuple[int, str]] = []
    for row in items.where("item is not null and text is not null").select(F.col("item").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _search(df: DataFrame, text: str, items: Items) -> DataFrame:
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = items.judge(_words(batch.column(at)))
            ids, shares = (batch.column(names.index(c)).to_pylist() for c in ("leaked_item", "leaked_share"))
            for doc, (share, item) in found.items():
                if ids[doc] is None or (share, -item) > (shares[doc], -ids[doc]):
                    ids[doc], shares[doc] = item, share
            columns = list(batch.columns)
            columns[names.index("leaked_item")] = pa.array(ids, pa.int64())
            columns[names.index("leaked_share")] = pa.array(shares, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` that hold no benchmark item."""
    found = find_leaks(df, benchmark, text).where(~F.col("contaminated"))
    return found.select(*[col(found, c) for c in df.columns])
