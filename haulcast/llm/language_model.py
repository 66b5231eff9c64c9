"""Operator 8: score texts by a language model of online logistic context mixing.

The training documents are those whose ``crc32`` of the id leaves no remainder 1
modulo 5. Three passes read the texts:

1. Byte frequencies (for the code tree) and the most frequent words.
2. Each task runs through its training texts: it guesses the next units from the
   counts it has, moves the mixing weights online, notes how guesses turned
   out, then counts the units. Counts are summed and weights averaged over tasks.
3. Every task scores the units of its texts whose word is frequent at once. The
   rest goes, each unit once per load of texts, to the bucket of its word, where
   the word's training count is complete and the unit is scored once; sums per
   document come back by load. A frequent word thus never gathers in one task.

The score is the sum over the text's bits, log10; the base score is that of
single words with half a count added to each.

Defined cases: a null or empty text has one token, its end; a null id is a
training document of its own; repeated rows count and are scored each; no
training document leaves no known token; an empty table gives no rows. Tables,
weights and the list of frequent words have fixed sizes; no text is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm import mixer
from haulcast.llm.decontaminate import summed
from haulcast.llm.mixer import END, PREVIOUS, Bits, Code, Counts, Mixer, Model
from haulcast.llm.substrings import _packed, _unpacked
from haulcast.llm.tables import only, spread
from haulcast.llm.words import LOWER, SPACES, bytes_of, gathered, mix, span_hash_bytes, steps, strings, text_buffer
from haulcast.staging import stage_table

#: Words with a larger share of the training tokens are frequent: fewer than 1 / FREQUENT.
FREQUENT = 1 / 20_000
#: Bytes of text of a step: repeated units of it are handled once.
STEP = 12 << 20
#: The same where texts are scored: batches are put together, as no result depends on how texts are cut.
SCORED_STEP = 8 << 20
LOAD = 24 << 20
HELD_OUT = 1
FOLDS = 5


class Units:
    """Units of a batch of texts: bytes up to a separator or the end."""

    def __init__(self, column: pa.Array) -> None:
        codes, offsets = text_buffer(column)
        size = np.diff(offsets)
        whole = np.full(len(codes) + len(size), END, np.uint8)
        self.texts = offsets + np.arange(len(offsets))
        whole[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = np.minimum(LOWER[codes], END - 1)
        self.codes = whole
        close = np.flatnonzero(SPACES[whole] | (whole == END))
        self.offsets = np.append(0, close + 1)
        self.doc = np.searchsorted(self.texts, close, "right") - 1
        self.word = span_hash_bytes(whole, self.offsets[:-1], close)
        self.spoken = close > self.offsets[:-1]
        self.word[~self.spoken] = 0
        before = np.zeros(len(close), np.int64)
        before[1:] = (self.word[:-1] % np.uint64(PREVIOUS)).astype(np.int64)
        before[1:][self.doc[1:] != self.doc[:-1]] = 0
        self.previous = before
        self.key = mix(self.word + np.uint64(0x9E3779B97F4A7C15) * whole[close].astype(np.uint64)) ^ mix(
            before.astype(np.uint64) + np.uint64(977)
        )

    def pick(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of some units."""
        return bytes_of(self.codes, self.offsets[at], self.offsets[at + 1])

    def tokens(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc[self.spoken], minlength=len(self.texts) - 1)


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of the id as text leaves the remainder of the held-out fold."""
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT if i is not None else False for i in ids.to_pylist()], bool)


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(~held_out(batch.column("id"))))


def first_pass(named: DataFrame) -> tuple[Code, list[int]]:
    """Code tree of the training bytes, and candidates for frequent words."""

    def bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        words: dict[int, int] = {}
        total = 0
        for batch in steps(batches, "text"):
            units = Units(_training(batch).column("text"))
            seen += np.bincount(units.codes, minlength=256)
            word, n = np.unique(units.word[units.spoken], return_counts=True)
            total += int(n.sum())
            often = n >= max(2, n.sum() * FREQUENT / 2)
            for w, k in zip(word[often].view(np.int64).tolist(), n[often].tolist()):
                words[w] = words.get(w, 0) + k
        words = {w: k for w, k in words.items() if k >= total * FREQUENT / 2}
        kinds = [0] * 256 + [1] * len(words) + [2]
        columns = [pa.array(kinds, pa.int32()), pa.array([*range(256), *words, 0], pa.int64()), pa.array([*seen.tolist(), *words.values(), total], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "item", "n"])

    rows = named.mapInArrow(bytes_seen, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    rows = stage_table(rows, "symbols")
    counts = np.zeros(256)
    for row in rows.where("kind = 0").collect():
        counts[row["item"]] = row["n"]
    total = rows.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    often = rows.where((F.col("kind") == 1) & (F.col("n") >= F.lit(total * FREQUENT))).select("item").collect()
    return Code.of(counts), sorted(row["item"] for row in often)


def teach(code: Code, units: Units, counts: Counts, online: Mixer) -> None:
    """All units teach the mixer from the counts so far and are counted then, each once with its weight."""
    _, at, n = np.unique(units.key, return_index=True, return_counts=True)
    codes, offsets = units.pick(at)
    for low, high in mixer.blocks(offsets):
        first, last = offsets[low], offsets[high]
        inside = offsets[low : high + 1] - first
        bits = Bits.of(code, codes[first:last], inside, units.previous[at[low:high]])
        mass = bits.of_bytes(np.repeat(n[low:high].astype(np.float64), np.diff(inside)))
        online.learn(bits, counts.guess(bits), mass)
        counts.add(bits, mass)


def second_pass(named: DataFrame, code: Code, frequent: np.ndarray) -> tuple[Model, np.ndarray]:
    """The trained model, and exact training counts of the frequent words."""
    sizes = [2 << b for b in mixer.TABLE_BITS]
    cells = mixer.NODES * mixer.STEPS
    size = sum(sizes) + mixer.PREDICTORS * mixer.NODES + 1 + 2 * cells + len(frequent)

    def train(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts, online = Counts(), Mixer()
        prior = online.ones.copy(), online.seen.copy()
        words = np.zeros(len(frequent))
        for batch in steps(batches, "text", STEP):
            units = Units(_training(batch).column("text"))
            teach(code, units, counts, online)
            place = np.searchsorted(frequent, units.word) if len(frequent) else np.zeros(0, np.int64)
            if len(frequent):
                place[place == len(frequent)] = 0
                hit = units.spoken & (frequent[place] == units.word)
                words += np.bincount(place[hit], minlength=len(frequent))
        return np.concatenate(
            [
                *counts.tables,
                (online.weights * online.total).ravel(),
                [online.total],
                online.ones - prior[0],
                online.seen - prior[1],
                words,
            ]
        )

    vector = summed(named, train, size)
    cuts = np.cumsum([*sizes, mixer.PREDICTORS * mixer.NODES, 1, cells, cells])
    *tables, weights, total, ones, seen, words = np.split(vector, cuts)
    start = Mixer()
    mixed = weights.reshape(mixer.PREDICTORS, mixer.NODES) / total[0] if total[0] else start.weights
    model = Model(
        code,
        Counts([t.astype(np.float32) for t in tables]).guesses(),
        mixed.astype(np.float32),
        ((ones + start.ones) / (seen + start.seen)).astype(np.float32),
    )
    return model, words


_DICT = pa.schema([("key", pa.uint64()), ("word", pa.uint64()), ("spoken", pa.bool_()), ("previous", pa.int16()), ("unit", pa.binary())])
_ROWS = pa.schema([("doc", pa.int32()), ("key", pa.int32()), ("n", pa.int32())])
_DOCS = pa.schema(
    [
        ("id", pa.int64()),
        ("held", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
    ]
)
_SUMS = pa.schema([("doc", pa.int32()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SENT = "bucket long, load long, units binary, rows binary, docs binary"
BACK = "load long, docs binary, sums binary, tokens long, words long"
SCORED = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, tokens long, words long"


class _Load:
    """Units of some texts that are not frequent, and what is known of the texts already."""

    def __init__(self, model: Model, frequent: np.ndarray, counts: np.ndarray, buckets: int) -> None:
        self.model, self.frequent, self.counts, self.buckets = model, frequent, counts, buckets
        self._clear()

    def _clear(self) -> None:
        self.docs: list[pa.Table] = []
        self.units: list[pa.Table] = []
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        units = Units(batch.column("text"))
        held = held_out(batch.column("id"))
        n_docs = len(held)
        key, at, back = np.unique(units.key, return_index=True, return_inverse=True)
        word, spoken = units.word[at], units.spoken[at]
        place = np.searchsorted(self.frequent, word)
        place[place == len(self.frequent)] = 0
        known = spoken & (self.frequent[place] == word) if len(self.frequent) else np.zeros(len(at), bool)
        here = known | ~spoken
        score, base, seen = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
        codes, offsets = units.pick(at[here])
        score[here] = self.model.log10(codes, offsets, units.previous[at[here]])
        if known.any():
            base[known] = np.log10(self.counts[place[known]] + 0.5)
            seen[known] = self.counts[place[known]] > 0
        sums = [np.bincount(units.doc, x[back], n_docs) for x in (seen, base, score)]
        columns = [batch.column("id").cast(pa.int64()), held, units.tokens() + 1, sums[0].astype(np.int64), sums[1], sums[2]]
        self.docs.append(pa.table([pa.array(c) for c in columns], schema=_DOCS))
        # What remains is sent, one row per place, negative for texts that do not train.
        far = np.flatnonzero(~here)
        codes, offsets = units.pick(at[far])
        text = strings(codes, offsets)
        binary = text.view(pa.binary()) if pa.types.is_string(text.type) else text.view(pa.large_binary()).cast(pa.binary())
        self.units.append(
            pa.table(
                [pa.array(key[far]), pa.array(word[far]), pa.array(spoken[far]), pa.array(units.previous[at[far]].astype(np.int16)), binary],
                schema=_DICT,
            )
        )
        sent = ~here[back]
        doc = units.doc[sent]
        self.rows.append((doc + self.n_docs, key[back[sent]], np.where(held[doc], -1, 1)))
        self.n_docs += n_docs
        self.held += len(units.codes)

    def sent(self, load: int) -> Iterator[pa.RecordBatch]:
        if not self.n_docs:
            return
        docs = pa.concat_tables(self.docs)
        whole = pa.concat_tables(self.units).combine_chunks()
        doc, row_key, n = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        self._clear()
        yield _sent(load % self.buckets, load, None, None, _packed(docs))
        if not whole.num_rows:
            return
        keys, first = np.unique(whole["key"].to_numpy(), return_index=True)
        bucket = (mix(whole["word"].to_numpy()[first]) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        units = whole.take(pa.array(first[order])).combine_chunks()
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        place = rank[np.searchsorted(keys, row_key)]
        by_place = np.argsort(place, kind="stable")
        doc, place, n = doc[by_place], place[by_place], n[by_place]
        bucket = bucket[order]
        cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        ends = np.searchsorted(place, cut)
        for i in range(len(cut) - 1):
            low, high = ends[i], ends[i + 1]
            part = [doc[low:high], place[low:high] - cut[i], n[low:high]]
            rows = pa.table([pa.array(x.astype(np.int32)) for x in part], schema=_ROWS)
            yield _sent(int(bucket[cut[i]]), load, _packed(units.slice(cut[i], cut[i + 1] - cut[i]), 1), _packed(rows, 1), None)


def _sent(bucket: int, load: int, units: bytes | None, rows: bytes | None, docs: bytes | None) -> pa.RecordBatch:
    columns = [pa.array([bucket], pa.int64()), pa.array([load], pa.int64()), *[pa.array([x], pa.binary()) for x in (units, rows, docs)]]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "load", "units", "rows", "docs"])


def _back(load: int, docs: bytes | None, sums: bytes | None, tokens: int = 0, words: int = 0) -> pa.RecordBatch:
    columns = [pa.array([load], pa.int64()), pa.array([docs], pa.binary()), pa.array([sums], pa.binary()), pa.array([tokens]), pa.array([words])]
    return pa.RecordBatch.from_arrays(columns, names=["load", "docs", "sums", "tokens", "words"])


def score_bucket(parts: list[tuple[int, pa.Table, pa.Table]], model: Model) -> Iterator[pa.RecordBatch]:
    """Sums per document of a bucket's units (load, units, rows), and its training tokens and words."""
    units = pa.concat_tables([p[1] for p in parts]).combine_chunks()
    starts = np.cumsum([0, *[p[1].num_rows for p in parts]])
    rows = [[p[2][c].to_numpy() for c in ("doc", "key", "n")] for p in parts]
    keys, first, back = np.unique(units["key"].to_numpy(), return_index=True, return_inverse=True)
    words, word = np.unique(units["word"].to_numpy()[first], return_inverse=True)
    seen = np.zeros(len(words))
    for start, (_, key, n) in zip(starts, rows):
        seen += np.bincount(word[back[start + key]], np.maximum(n, 0), len(words))
    text = units["unit"].chunk(0).take(pa.array(first))
    codes, offsets = text_buffer(text)
    score = model.log10(codes, offsets, units["previous"].to_numpy()[first].astype(np.int64))
    base, known = np.log10(seen + 0.5)[word], (seen > 0)[word]
    for (load, _, _), start, (doc, key, n) in zip(parts, starts, rows):
        unit, times = back[start + key], np.abs(n)
        docs, place = np.unique(doc, return_inverse=True)
        sums = [np.bincount(place, x[unit] * times, len(docs)) for x in (known, base, score)]
        columns = [docs, np.rint(sums[0]).astype(np.int64), sums[1], sums[2]]
        yield _back(load, None, _packed(pa.table([pa.array(c) for c in columns], schema=_SUMS)))
    yield _back(-1, None, None, int(seen.sum()), int((seen > 0).sum()))


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    named = only(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    code, words = first_pass(named)
    frequent = np.array(words, np.int64).view(np.uint64)
    frequent.sort()
    model, counts = second_pass(named, code, frequent)
    buckets = buckets or 4 * spread(df)
    model_of = named.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _Load(model_of.value, frequent, counts, buckets)
        number = TaskContext.get().partitionId() << 24
        for batch in gathered(batches, "text", SCORED_STEP):
            load.add(batch)
            if load.held >= LOAD:
                yield from load.sent(number)
                number += 1
        yield from load.sent(number)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket = [], None
        for batch in batches:
            for at, load, units, rows, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if at != bucket and parts:
                    yield from score_bucket(parts, model_of.value)
                    parts = []
                bucket = at
                if docs is not None:
                    yield _back(load, docs, None)
                if units is not None:
                    parts.append((load, _unpacked(units), _unpacked(rows)))
        if parts:
            yield from score_bucket(parts, model_of.value)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, docs, sums = None, [], []
        for batch in batches:
            for at, one, some, tokens, words in zip(*(c.to_pylist() for c in batch.columns)):
                if at != load and docs:
                    yield _scored(docs, sums)
                    docs, sums = [], []
                load = at
                if at == -1:
                    yield _totals(tokens, words)
                elif one is not None:
                    docs.append(_unpacked(one))
                else:
                    sums.append(_unpacked(some))
        if docs:
            yield _scored(docs, sums)

    there = named.mapInArrow(send, SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(score, BACK)
    back = there.repartition("load").sortWithinPartitions("load").mapInArrow(gather, SCORED)
    found = stage_table(back, "scores")
    total = found.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    ends = found.where("tokens is null and not held_out").count()
    train_tokens = int((total["tokens"] or 0) + counts.sum() + ends)
    distinct = int((total["words"] or 0) + (counts > 0).sum() + (ends > 0))
    end = float(np.log10(ends + 0.5))
    least = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return found.where("tokens is null").select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * least).alias("base_score"),
        "score",
    )


def _scored(docs: list[pa.Table], sums: list[pa.Table]) -> pa.RecordBatch:
    whole = pa.concat_tables(docs)
    known, base, score = (whole[c].to_numpy().copy() for c in ("n_known", "base", "score"))
    for part in sums:
        at = part["doc"].to_numpy()
        known[at] += part["n_known"].to_numpy()
        base[at] += part["base"].to_numpy()
        score[at] += part["score"].to_numpy()
    n = whole.num_rows
    none = pa.nulls(n, pa.int64())
    columns = [whole["id"].combine_chunks(), whole["held"].combine_chunks(), whole["n_tokens"].combine_chunks(), pa.array(known), pa.array(base), pa.array(score), none, none]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=SCORED_NAMES)


def _totals(tokens: int, words: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    columns = [*[pa.nulls(1, k) for k in kinds], pa.array([tokens]), pa.array([words])]
    return pa.RecordBatch.from_arrays(columns, names=SCORED_NAMES)


SCORED_NAMES = [part.split()[0] for part in SCORED.split(", ")]
