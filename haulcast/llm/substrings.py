"""Operator 9: remove repeated word windows by super-k-mers.

A window is ``size`` consecutive words of one text. Its minimiser is the least
hash among its runs of ``MINI`` words. Consecutive windows with one minimiser
form a super-k-mer, which travels to its minimiser's bucket as one packed
string instead of once per window; equal windows always meet there, as they
have the same minimiser. The bucket sorts its windows and keeps the earliest
place of each; the places of all others go back to their documents.

Two measures against hot windows: equal super-k-mers of one task's load are
reduced to the earliest before they travel (the later ones are repeats already
known), and a minimiser that is frequent in a sample of documents is refined by a
second, independent minimiser of the window, which splits its bucket. Neither
changes the result.

Order of places: document id, then word number; a null id comes last. A window
is removed if the same words start at a smaller place. Rows repeating an id
with the same text are one document; rows repeating an id with other texts
do not precede each other at equal word numbers. Null and empty texts have no
words; texts are never cut; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.tables import only, spread
from haulcast.llm.words import KEEP_CASE, Words, bytes_of, chain, mix, run_hash, signed, span_hash, steps, strings, words_of
from haulcast.staging import stage_table

WINDOW = 20
MINI = 5
#: Windows that one super-k-mer holds at most, so that a packed string stays short.
LONGEST = 64
#: Texts gathered before a task packs them into buckets, in bytes.
LOAD = 24 << 20
#: Of each this many documents one is looked at for frequent minimisers.
SAMPLE = 64
#: A minimiser is frequent if it starts more than this share of the sampled super-k-mers.
FREQUENT = 1 / 4096
#: Compression of packed strings.
LEVEL = 3
NULL_ID = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:]) if len(x) > reach else x[:0]
        reach *= 2
    rest = width - reach
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


def windows(words: Words, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket key and first word of each window that lies in one text."""
    many = len(words.hash) - size + 1
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = run_hash(words.hash, len(words.hash) - MINI + 1, MINI)
    key = sliding_min(parts, size - MINI + 1)
    if len(frequent):
        hot = np.isin(key, frequent)
        if hot.any():
            second = sliding_min(mix(parts ^ np.uint64(0x5851F42D4C957F2D)), size - MINI + 1)
            key = np.where(hot, chain([key, second]), key)
    at = np.flatnonzero(words.doc[:many] == words.doc[size - 1 :])
    return key[at], at


def super_kmers(key: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (by index) of each run of windows with one key in one text."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(key)))
    pieces = -(-sizes // LONGEST)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + inner * LONGEST
    return first, np.append(first[1:], len(key)) - 1


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one blank after each: bytes, and start and end of each word in them."""
    size = words.end - words.start + 1
    end = np.cumsum(size)
    # The byte after a word is a separator or belongs to the next text: it becomes the blank.
    codes = np.append(words.codes, np.uint8(0x20))
    out, _ = bytes_of(codes, words.start, words.end + 1)
    out[end - 1] = 0x20
    return out, end - size, end - 1


def text_mark(words: Words) -> np.ndarray:
    """A 64-bit hash of each text's words, to tell apart rows that repeat an id."""
    bounds = words.bounds
    sums = np.zeros(len(words.hash) + 1, np.uint64)
    place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    np.cumsum(mix(words.hash ^ mix(place)), out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _marks(words: Words) -> np.ndarray:
    return (text_mark(words) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


_LOAD_SCHEMA = pa.schema([("id", pa.int64()), ("mark", pa.int32()), ("place", pa.int32()), ("words", pa.string())])
_GONE_SCHEMA = pa.schema([("id", pa.int64()), ("mark", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
ROWS = "bucket long, load binary, gone binary"
RANGES = "id long, mark int, low int, high int"


def _packed(table: pa.Table, level: int = LEVEL) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _ranges(id_: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of removed windows joined into (id, mark, low, high)."""
    if not len(id_):
        return id_, mark, place, place
    order = np.lexsort((place, mark, id_))
    id_, mark, place = id_[order], mark[order], place[order]
    new = np.ones(len(id_), bool)
    new[1:] = (id_[1:] != id_[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] > place[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(id_)) - 1
    return id_[low], mark[low], place[low], place[high]


class _Load:
    """Super-k-mers of some texts, cut into buckets."""

    def __init__(self, size: int, buckets: int, frequent: np.ndarray) -> None:
        self.size, self.buckets, self.frequent = size, buckets, frequent
        self.parts: list[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        words = words_of(batch.column("text"), fold=KEEP_CASE)
        key, at = windows(words, self.size, self.frequent)
        first, last = super_kmers(key, at, words.doc[at])
        if not len(first):
            return
        codes, start, end = _spaced(words)
        low, high = at[first], at[last] + self.size
        text, offsets = bytes_of(codes, start[low], end[high - 1])
        doc = words.doc[low]
        ids, marks = _ids(batch.column("id")), _marks(words)
        columns = [ids[doc], marks[doc], (low - words.bounds[doc]).astype(np.int32)]
        packed = pa.table([*map(pa.array, columns), strings(text, offsets)], schema=_LOAD_SCHEMA)
        self.parts.append((packed, span_hash(words.hash, low, high), last - first, bucket_of(key[first], self.buckets)))
        self.held += int(words.offsets[-1])

    def rows(self) -> Iterator[tuple[int, bytes | None, bytes | None]]:
        """(bucket, packed super-k-mers, packed ranges already known to repeat)."""
        if not self.parts:
            return
        whole = pa.concat_tables([part[0] for part in self.parts]).combine_chunks()
        same, more, bucket = (np.concatenate([part[i] for part in self.parts]) for i in (1, 2, 3))
        self.parts, self.held = [], 0
        id_, mark, place = (whole[c].to_numpy() for c in ("id", "mark", "place"))
        # Equal strings stand together, the earliest place first.
        order = np.lexsort((place, id_, same))
        lead = np.append(True, same[order][1:] != same[order][:-1])
        heads = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        later = np.zeros(len(id_), bool)
        later[order] = (id_[order] != id_[heads]) | (place[order] != place[heads])
        kept = np.flatnonzero(~later)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        cut = np.flatnonzero(np.append(True, bucket[kept][1:] != bucket[kept][:-1]))
        sorted_ = whole.take(pa.array(kept)).combine_chunks()
        for low, high in zip(cut, np.append(cut[1:], len(kept))):
            yield int(bucket[kept[low]]), _packed(sorted_.slice(low, high - low)), None
        if later.any():
            gone = [id_[later], mark[later], place[later], place[later] + more[later].astype(np.int32)]
            yield int(bucket[np.argmax(later)]), None, _packed(pa.table([*map(pa.array, gone)], schema=_GONE_SCHEMA))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def later_windows(rows: pa.Table, size: int) -> pa.RecordBatch:
    """Ranges of windows in one bucket whose words start earlier elsewhere in it."""
    whole = rows.combine_chunks()
    text = whole["words"].chunk(0) if whole.num_rows else pa.array([], pa.string())
    words = words_of(text, fold=KEEP_CASE)
    many = max(len(words.hash) - size + 1, 0)
    at = np.flatnonzero(words.doc[:many] == words.doc[size - 1 :][:many])
    same = span_hash(words.hash, at, at + size)
    order = np.argsort(same)
    equal = same[order][1:] == same[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at, same = at[twice], same[twice]
    source = words.doc[at]
    id_, mark, place = (whole[c].to_numpy()[source] for c in ("id", "mark", "place"))
    place = place + (at - words.bounds[source]).astype(np.int32)
    order = np.lexsort((place, id_, same))
    id_, mark, place, same = id_[order], mark[order], place[order], same[order]
    lead = np.ones(len(same), bool)
    lead[1:] = same[1:] != same[:-1]
    heads = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(lead) else lead.astype(np.int64)
    later = (id_ != id_[heads]) | (place != place[heads])
    return _range_batch(id_[later], mark[later], place[later])


def _range_batch(id_: np.ndarray, mark: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, _ranges(id_, mark, place))], schema=_GONE_SCHEMA)


def frequent_minimisers(named: DataFrame, size: int) -> list[int]:
    """Minimisers of many super-k-mers in a sample of the texts: fewer than 1 / FREQUENT numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = words_of(batch.column("text"), fold=KEEP_CASE)
            key, at = windows(words, size, np.zeros(0, np.uint64))
            first, _ = super_kmers(key, at, words.doc[at])
            keys, n = np.unique(signed(key[first]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    sample = named.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stage_table(counts, "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [row["key"] for row in counts.where(F.col("n") > F.lit(max(8.0, total * FREQUENT))).select("key").collect()]


def repeated_ranges(named: DataFrame, size: int, buckets: int, frequent: list[int]) -> DataFrame:
    """(id, mark, low, high): numbers of the windows to remove."""
    hot = np.array(sorted(frequent), np.int64).view(np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _Load(size, buckets, hot)
        for batch in steps(batches, "text"):
            load.add(batch)
            if load.held >= LOAD:
                yield from _batches(load.rows())
        yield from _batches(load.rows())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for number, load, gone in zip(*(batch.column(c).to_pylist() for c in ("bucket", "load", "gone"))):
                if number != bucket and held:
                    yield later_windows(pa.concat_tables(held), size)
                    held = []
                bucket = number
                if gone is not None:
                    yield from _unpacked(gone).to_batches()
                if load is not None:
                    held.append(_unpacked(load))
        if held:
            yield later_windows(pa.concat_tables(held), size)

    rows = named.mapInArrow(pack, ROWS)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, RANGES)


def _batches(rows: Iterator[tuple[int, bytes | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
    for bucket, load, gone in rows:
        columns = [pa.array([bucket], pa.int64()), pa.array([load], pa.binary()), pa.array([gone], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "load", "gone"])


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, buckets: int | None = None
) -> DataFrame:
    """(key, n_words, n_removed, text) of every row: the words no repeated window covers, joined by blanks."""
    named = only(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    buckets = buckets or 8 * spread(df)
    found = repeated_ranges(named, size, buckets, frequent_minimisers(named, size))
    ranges = found.groupBy("id").agg(F.collect_list(F.struct("mark", "low", "high")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = words_of(batch.column("text"), fold=KEEP_CASE)
            bounds, marks = words.bounds, _marks(words)
            edges = np.zeros(len(words.hash) + 1, np.int64)
            for i, gone in enumerate(batch.column("ranges").to_pylist()):
                for r in gone or ():
                    if r["mark"] == marks[i]:
                        edges[bounds[i] + r["low"]] += 1
                        edges[bounds[i] + r["high"] + size] -= 1
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
            codes, start, end = _spaced(words)
            per_doc = np.searchsorted(kept, bounds)
            close = end[kept] + 1
            last = per_doc[1:][np.diff(per_doc) > 0] - 1
            close[last] -= 1
            out, offsets = bytes_of(codes, start[kept], close)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(n - np.diff(per_doc)), strings(out, offsets[per_doc])],
                names=["id", "n_words", "n_removed", "text"],
            )

    joined = named.withColumn("at", F.coalesce("id", F.lit(int(NULL_ID)))).join(
        ranges.withColumnRenamed("id", "at"), "at", "left"
    )
    out = joined.select("id", "text", "ranges").mapInArrow(run, "id long, n_words long, n_removed long, text string")
    return out.withColumnRenamed("id", key)
