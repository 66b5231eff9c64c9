"""Operator 11: token ids of a corpus in range-coded binary blocks.

Documents are dealt out to parts by ranges of their id, as many as their counted
bytes ask for. A part encodes its texts, appends the end id to each document and
cuts the stream of ids into blocks of ``Format.block`` ids. A block is coded by
itself (see ``id_coder``) into a frame of bytes: a header with mark, number of
ids, vocabulary size and CRC-32 of the ids, then the coded words. Frames are rows
of a Parquet table beside the documents that the block touches, so any block can
be read alone and a lost task is written again whole. Reading checks every frame.

Words between ASCII white space never influence each other's ids in the
tokenizers this is made for (white space is dropped before words are split);
each distinct word is encoded once per task, many of them in one call.

Defined cases: a null or empty text is its end id alone; a null id comes first,
as in an ascending sort; rows that repeat an id follow each other in the order of
their text's hash, each with a place of its own; an empty table gives an empty
file and no rows; other columns are ignored, whatever their names. A frame whose
checksum fails ends the reading job with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcast.llm import id_coder
from haulcast.llm.tables import only
from haulcast.llm.token_cache import IdCache, word_encoder
from haulcast.llm.words import KEEP_CASE, SPACES, steps, words_of

MAGIC = b"HCT1"
HEADER = struct.Struct("<4sIII")  # mark, ids, vocabulary size, CRC-32 of the ids as little-endian 32-bit numbers

FRAMES = (
    "part int, block bigint, first bigint, n int, frame binary, "
    "doc_ids array<bigint>, doc_firsts array<bigint>, doc_counts array<bigint>"
)
PIECES = "part int, doc_first bigint, doc_id bigint, n_tokens bigint, at bigint, n bigint, crc bigint"


@dataclass(frozen=True)
class Format:
    """Parameters of the file."""

    tokenizer: str
    end_id: int = 1
    size: int = 49408
    block: int = 2048
    #: Blocks that a task codes side by side, which bounds its memory.
    lanes: int = 2048
    #: Bytes of text in a part.
    part_bytes: int = 32 << 20


def write_tokens(docs: DataFrame, path: str, form: Format) -> None:
    """Encode all documents and write them to ``path`` in ascending id order."""
    rows = only(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-total // form.part_bytes))
    # Rows that repeat an id, or all of a row, still spread over parts.
    order = ["doc_id", "h", "row"]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write(form), FRAMES).write.parquet(path)


@dataclass
class _Waiting:
    """Ids that are not yet in a frame, and the documents they belong to."""

    first: int
    ids: list[np.ndarray]
    docs: list[pa.RecordBatch]


def _write(form: Format) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = IdCache(word_encoder(form.tokenizer))
        part = TaskContext.get().partitionId()
        ids, n_ids, first = [], 0, 0  # waiting ids, and the place of the first of them in the part
        doc_ids, doc_firsts, doc_counts = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for step in steps(batches, "text"):
            more, counts = _encoded(step.column("text"), cache, form.end_id)
            doc_ids = pa.concat_arrays([doc_ids, step.column("doc_id")])
            doc_firsts = np.concatenate([doc_firsts, first + n_ids + np.cumsum(counts) - counts])
            doc_counts = np.concatenate([doc_counts, counts])
            ids.append(more)
            n_ids += len(more)
            while n_ids >= form.block * form.lanes:
                stream = np.concatenate(ids)
                now, rest = np.split(stream, [form.block * form.lanes])
                yield _frames(part, first, now, doc_ids, doc_firsts, doc_counts, form)
                ids, n_ids, first = [rest], len(rest), first + len(now)
                done = int(np.searchsorted(doc_firsts + doc_counts, first, "right"))
                doc_ids, doc_firsts, doc_counts = doc_ids.slice(done), doc_firsts[done:], doc_counts[done:]
        if n_ids:
            yield _frames(part, first, np.concatenate(ids), doc_ids, doc_firsts, doc_counts, form)

    return run


def _encoded(texts: pa.Array, cache: IdCache, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in a row, each followed by the end id, and how many each has."""
    words = words_of(texts, SPACES, KEEP_CASE)
    ids, per_word = cache.encode(words.codes, words.start, words.end, words.hash)
    counts = np.bincount(words.doc, per_word, len(texts)).astype(np.int64) + 1
    out = np.full(len(ids) + len(texts), end_id, np.uint32)
    # An id moves on by one place for each document that ended before it.
    out[np.arange(len(ids)) + np.repeat(words.doc, per_word)] = ids
    return out, counts


def _frames(part: int, first: int, ids: np.ndarray, doc_ids: pa.Array, doc_firsts: np.ndarray, doc_counts: np.ndarray, form: Format) -> pa.RecordBatch:
    lanes = -(-len(ids) // form.block)
    lengths = np.full(lanes, form.block)
    lengths[-1] = len(ids) - form.block * (lanes - 1)
    padded = np.zeros(lanes * form.block, np.uint32)
    padded[: len(ids)] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, form.block).T)[: lengths[0]]
    frames = []
    for i, payload in enumerate(id_coder.encode(table, lengths, form.size)):
        held = padded[i * form.block : i * form.block + lengths[i]].astype("<u4").tobytes()
        frames.append(HEADER.pack(MAGIC, lengths[i], form.size, zlib.crc32(held)) + payload)
    at = first + form.block * np.arange(lanes)
    # Documents that a block touches: from the one that holds its first id to the one that holds its last.
    low = np.searchsorted(doc_firsts + doc_counts, at, "right")
    high = np.searchsorted(doc_firsts, at + lengths, "left")
    touched = pa.array(np.concatenate([np.arange(a, b) for a, b in zip(low, high)]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(high - low)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, column.take(touched)) for column in (doc_ids, pa.array(doc_firsts), pa.array(doc_counts))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(lanes, part, np.int32)),
            pa.array(at // form.block),
            pa.array(at),
            pa.array(lengths.astype(np.int32)),
            pa.array(frames, pa.binary()),
            *lists,
        ],
        ["part", "block", "first", "n", "frame", "doc_ids", "doc_firsts", "doc_counts"],
    )


def _ids_of(frames: list[bytes]) -> list[np.ndarray]:
    """Ids of each frame, checked; frames are decoded side by side."""
    heads = [HEADER.unpack_from(f) for f in frames]
    for mark, _, size, _ in heads:
        if mark != MAGIC or size != heads[0][2]:
            raise ValueError("not a frame of token ids of this vocabulary")
    lengths = np.array([n for _, n, _, _ in heads])
    order = np.argsort(-lengths, kind="stable")
    table = id_coder.decode([frames[i][HEADER.size :] for i in order], lengths[order], heads[0][2])
    out = [np.zeros(0, np.uint32)] * len(frames)
    for lane, i in enumerate(order):
        out[i] = np.ascontiguousarray(table[: lengths[i], lane])
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][3]:
            raise ValueError("a frame of token ids fails its checksum")
    return out


def _read(lanes: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= lanes:
                yield _pieces(waiting[:lanes], with_ids)
                waiting = waiting[lanes:]
        if waiting:
            yield _pieces(waiting, with_ids)

    return run


def _pieces(rows: list[dict], with_ids: bool) -> pa.RecordBatch:
    """One row per block and document: its ids there, and their CRC-32 moved to their place in the document."""
    out = []
    for row, ids in zip(rows, _ids_of([r["frame"] for r in rows])):
        data = ids.astype("<u4").tobytes()
        for doc_id, first, n_tokens in zip(row["doc_ids"], row["doc_firsts"], row["doc_counts"]):
            low, high = max(first, row["first"]), min(first + n_tokens, row["first"] + row["n"])
            held = data[4 * (low - row["first"]) : 4 * (high - row["first"])]
            piece = (row["part"], first, doc_id, n_tokens, low - first, high - low, zlib.crc32(held))
            out.append((*piece, held) if with_ids else piece)
    columns = [list(c) for c in zip(*out)]
    after = 4 * (np.array(columns[3]) - np.array(columns[4]) - np.array(columns[5]))
    columns[6] = crc_before(np.array(columns[6], np.int64), after)
    kinds = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * with_ids]
    names = ["part", "doc_first", "doc_id", "n_tokens", "at", "n", "crc", *["ids"] * with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_POLYNOMIAL = 0xEDB88320  # CRC-32, lowest bit first


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= b * ((a >> bit) & 1)
        b = (b >> 1) ^ (_POLYNOMIAL * (b & 1))
    return out


def crc_before(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC-32 of a text in which ``n_bytes`` bytes follow: the CRC is the XOR of these."""
    out, power, left = crc.copy(), np.full(1, 0x00800000, np.int64), n_bytes.copy()  # x^8: one byte
    while left.any():
        odd = (left & 1) == 1
        out[odd] = _times(out[odd], np.broadcast_to(power, int(odd.sum())))
        power, left = _times(power, power), left >> 1
    return out


def _starts(frames: DataFrame) -> DataFrame:
    """(part, part_start): ids of all parts before each. Thousand parts are summed side by side."""
    sizes = frames.groupBy("part").agg(F.sum("n").alias("n")).withColumn("some", F.floor(F.col("part") / 1000))
    groups = sizes.groupBy("some").agg(F.sum("n").alias("n"))
    before = Window.orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("some", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("some").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("part", "some", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside"))
    return inner.join(groups, "some").select("part", (F.col("start") + F.col("inside")).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, lanes: int = Format.lanes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file, and its ids as an array if asked for."""
    frames = spark.read.parquet(path)
    pieces = frames.mapInArrow(_read(lanes, with_ids), PIECES + ", ids binary" * with_ids)
    found = [F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n").alias("found"), F.bit_xor("crc").alias("crc")]
    if with_ids:
        found.append(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("pieces"))
    docs = pieces.groupBy("part", "doc_first").agg(*found).join(_starts(frames.select("part", "n")), "part")
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("crc")).otherwise(
        F.raise_error(F.lit("a block of the file is missing")).cast("bigint")
    )
    out = ["doc_id", (F.col("part_start") + F.col("doc_first")).alias("start"), "n_tokens", whole.alias("ids_crc32")]
    if not with_ids:
        return docs.select(*out)
    digests = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return docs.select(*out, F.col("pieces.ids").alias("parts")).mapInArrow(_joined, digests + ", ids array<bigint>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [np.frombuffer(b"".join(parts), "<u4").astype(np.int64) for parts in batch.column("parts").to_pylist()]
        ids = pa.array(whole, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])
