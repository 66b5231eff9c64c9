"""Operator 12: align the tokens of two tokenizers by lockstep merging.

Both tokenizers cut the same bytes. One state vector holds, for many strings at
once, which token of A and which token of B each has reached. A step emits the
link between the two, a cut where both end at the same byte, and moves on the
one that ends first, or both; strings that are done leave the vector.

Texts come apart at blanks after an ASCII letter, digit or mark: neither
tokenizer joins across such a place, so tokens of both end there. Each distinct
piece of a task is encoded and merged once. What documents share across the
corpus, the counts of linked id pairs, is summed in Spark: a chunk of documents
asks once for each pair it holds, the answers return to the chunk, and the
documents add them up.

Defined cases: null and empty texts, and texts that either tokenizer does not
give back byte by byte, have no tokens and count for nothing; documents that
repeat an id or a text are rows of their own; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.tables import only
from haulcast.llm.token_cache import PieceCache, json_encoder, piece_encoder
from haulcast.llm.words import bytes_of, span_hash_bytes, steps, text_buffer
from haulcast.staging import stage_table

if TYPE_CHECKING:
    from sentencepiece import SentencePieceProcessor

#: Bytes of text whose documents ask together for the counts of their pairs.
CHUNK = 4 << 20
B_BITS = 20

DOC, PLAN, ASKED = 0, 1, 2
STAGED = (
    "kind int, chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, groups string, data binary, pairs array<bigint>, counts array<bigint>"
)
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


@dataclass(frozen=True)
class Pair:
    """The files of the two tokenizers."""

    a: str
    b: str


# --- bytes of tokens ---------------------------------------------------------


@dataclass
class TokenBytes:
    """The bytes of every token of a vocabulary."""

    codes: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> TokenBytes:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return TokenBytes(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids + 1] - self.offsets[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return bytes_of(self.codes, self.offsets[ids], self.offsets[ids + 1])[0]


def byte_level_bytes(path: str) -> TokenBytes:
    """Entries stand for bytes, one character each: visible ones for themselves, the others from U+0100 on."""
    from tokenizers import Tokenizer

    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        plain = all(c in byte_of for c in entry)
        tokens[i] = bytes(byte_of[c] for c in entry) if plain else entry.encode()
    return TokenBytes.of(tokens)


def piece_bytes(path: str) -> TokenBytes:
    """Pieces in UTF-8 with a blank for U+2581; byte pieces are their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("pieces of this model reach across blanks: texts cannot be cut there")
    return TokenBytes.of([_piece(model, i) for i in range(model.get_piece_size())])


def _piece(model: SentencePieceProcessor, i: int) -> bytes:
    text = model.id_to_piece(i)
    return bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()


# --- merging -----------------------------------------------------------------


@dataclass
class Links:
    """Links in the order of their strings; A and B by place among all tokens, ``cut`` where both end."""

    string: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def merge(a_ends: np.ndarray, a_counts: np.ndarray, b_ends: np.ndarray, b_counts: np.ndarray) -> Links:
    """Merge the tokens of many strings in lockstep.

    ``a_ends`` and ``b_ends`` are the byte ends of all tokens inside their strings, ``*_counts`` how many tokens
    each string has. The tokens of A and of B end at the same last byte; a string has both kinds or neither.
    """
    a_stop = np.cumsum(a_counts)
    string = np.flatnonzero(a_counts)
    state = np.stack([(a_stop - a_counts)[string], (np.cumsum(b_counts) - b_counts)[string]])
    stop = a_stop[string]
    out: list[tuple[np.ndarray, ...]] = []
    while len(string):
        a_end, b_end = a_ends[state[0]], b_ends[state[1]]
        out.append((string, state[0], state[1], a_end == b_end))
        state = state + np.stack([a_end <= b_end, b_end <= a_end])
        alive = state[0] < stop
        if not alive.all():
            state, stop, string = state[:, alive], stop[alive], string[alive]
    if not out:
        return Links(*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    columns = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(columns[0], kind="stable")
    return Links(*[c[order] for c in columns])


def _inner_ends(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Byte end of each token inside its string."""
    ends = np.cumsum(sizes)
    firsts = np.cumsum(counts) - counts
    before = np.concatenate([[0], ends])[firsts]
    return ends - np.repeat(before, counts)


class AlignedPieces:
    """Tokens, groups and links of distinct pieces."""

    def __init__(self, pair: Pair) -> None:
        self._encode_a, self._encode_b = json_encoder(pair.a, specials_are_text=True), piece_encoder(pair.b)
        self._bytes_a, self._bytes_b = byte_level_bytes(pair.a), piece_bytes(pair.b)
        self._clear()
        self.pieces = PieceCache(self._more, self._clear)

    def _clear(self) -> None:
        #: Per piece: whether both tokenizers give it back; tokens of A, of B, groups, links.
        self.sound = np.zeros(0, bool)
        self.sizes = np.zeros((4, 0), np.int64)
        self.groups: list[str] = []
        self.links = np.zeros(0, np.int64)
        self.link_offsets = np.zeros(1, np.int64)

    def _more(self, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        # A piece begins with the blank that B's library puts before a text.
        a_ids, a_counts = self._encode_a(texts)
        b_ids, b_counts = self._encode_b([t[1:] for t in texts])
        sound = _gives_back(self._bytes_a, a_ids, a_counts, raw) & _gives_back(self._bytes_b, b_ids, b_counts, raw)
        a_ids, b_ids = a_ids[np.repeat(sound, a_counts)], b_ids[np.repeat(sound, b_counts)]
        a_counts, b_counts = a_counts * sound, b_counts * sound
        links = merge(
            _inner_ends(self._bytes_a.sizes(a_ids), a_counts), a_counts, _inner_ends(self._bytes_b.sizes(b_ids), b_counts), b_counts
        )
        n = len(texts)
        n_links = np.bincount(links.string, minlength=n)
        n_groups = np.bincount(links.string, links.cut, n).astype(np.int64)
        codes = a_ids[links.a] << B_BITS | b_ids[links.b]
        self.sound = np.concatenate([self.sound, sound])
        self.sizes = np.concatenate([self.sizes, [a_counts, b_counts, n_groups, n_links]], axis=1)
        self.groups += _group_texts(links, a_ids, b_ids, n_groups)
        self.links = np.concatenate([self.links, codes])
        self.link_offsets = np.concatenate([self.link_offsets, self.link_offsets[-1] + np.cumsum(n_links)])


def _gives_back(tokens: TokenBytes, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each string's tokens are its own."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    string = np.repeat(np.arange(len(raw)), counts)
    fits = np.bincount(string, tokens.sizes(ids), len(raw)).astype(np.int64) == lengths
    mine = tokens.joined(ids[fits[string]])
    theirs = np.frombuffer(b"".join(r for r, f in zip(raw, fits.tolist()) if f), np.uint8)
    ends = np.cumsum(lengths[fits])
    wrong = np.searchsorted(ends, np.flatnonzero(mine != theirs), "right")
    fits[np.flatnonzero(fits)[wrong]] = False
    return fits


def _group_texts(links: Links, a_ids: np.ndarray, b_ids: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each string."""
    a_names, b_names = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    a_cuts, b_cuts = (links.a[links.cut] + 1).tolist(), (links.b[links.cut] + 1).tolist()
    # Strings without tokens have no places, so the groups of all strings lie one after the other.
    each = [
        ",".join(a_names[a0:a1]) + "|" + ",".join(b_names[b0:b1])
        for a0, a1, b0, b1 in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts)
    ]
    ends = np.cumsum(n_groups).tolist()
    return [";".join(each[a:b]) for a, b in zip([0, *ends], ends)]


# --- documents ---------------------------------------------------------------


def _cut(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the pieces of all texts.

    A piece starts at a blank after a visible ASCII character; a blank that ends its text stays with the piece before.
    """
    visible = (codes[:-1] > 0x20) & (codes[:-1] < 0x7F)
    inner = np.flatnonzero((codes[1:] == 0x20) & visible) + 1
    inner = np.setdiff1d(inner, offsets[1:] - 1, assume_unique=False)
    start = np.union1d(inner, offsets[:-1][offsets[:-1] < offsets[1:]])
    end = np.append(start[1:], offsets[-1])[: len(start)]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _align(pair: Pair, keep_groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = AlignedPieces(pair)
        first = TaskContext.get().partitionId() << 32
        for i, step in enumerate(steps(_gathered(batches), "text", CHUNK)):
            yield from _chunk(first + i, step, known, keep_groups)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about one chunk of text."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _chunk(number: int, docs: pa.RecordBatch, known: AlignedPieces, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk: its documents, which pairs their pieces hold, and the pairs with their counts in the chunk."""
    texts = pc.fill_null(docs.column("text"), "")
    n = len(texts)
    codes, offsets = text_buffer(pc.binary_join_element_wise(" ", texts, ""))
    start, end, doc = _cut(codes, offsets)
    known.pieces.start()
    piece = known.pieces.numbers(codes, start, end, span_hash_bytes(codes, start, end))
    # Space and nothing more, or a piece that does not come back: no tokens.
    sound = (np.diff(offsets) > 1) & (np.bincount(doc, ~known.sound[piece], n) == 0)
    piece, doc = piece[sound[doc]], doc[sound[doc]]
    sizes = [np.bincount(doc, row[piece], n).astype(np.int64) for row in known.sizes]
    used, local, times = np.unique(piece, return_inverse=True, return_counts=True)
    held, _ = bytes_of(known.links, known.link_offsets[used], known.link_offsets[used + 1])
    n_links = known.link_offsets[used + 1] - known.link_offsets[used]
    pairs, place = np.unique(held, return_inverse=True)
    counts = np.bincount(place, np.repeat(times, n_links), len(pairs)).astype(np.int64)

    names = [known.groups[p] for p in used.tolist()]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    groups = [";".join([names[p] for p in local[a:b].tolist()]) for a, b in zip(bounds, bounds[1:])]
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    own = local.astype(np.uint32)
    yield _rows(
        kind=DOC,
        chunk=number,
        n=n,
        doc_id=docs.column("doc_id"),
        **dict(zip(["n_a", "n_b", "n_groups", "n_links"], map(pa.array, sizes))),
        groups_sha256=pa.array(digests),
        groups=pa.array(groups if keep_groups else [None] * n, pa.string()),
        data=pa.array([own[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
    )
    plan = np.concatenate([[len(used)], n_links, place]).astype(np.uint32).tobytes()
    yield _rows(kind=PLAN, chunk=number, n=1, data=pa.array([plan], pa.binary()))
    yield _rows(kind=ASKED, chunk=number, n=1, pairs=pa.array([pairs], pa.list_(pa.int64())), counts=pa.array([counts], pa.list_(pa.int64())))


_KINDS = {
    "kind": pa.int32(),
    "chunk": pa.int64(),
    "doc_id": pa.int64(),
    "n_a": pa.int64(),
    "n_b": pa.int64(),
    "n_groups": pa.int64(),
    "n_links": pa.int64(),
    "groups_sha256": pa.string(),
    "groups": pa.string(),
    "data": pa.binary(),
    "pairs": pa.list_(pa.int64()),
    "counts": pa.list_(pa.int64()),
}


def _rows(kind: int, chunk: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    columns |= {"kind": pa.array([kind] * n, pa.int32()), "chunk": pa.array([chunk] * n, pa.int64())}
    arrays = [columns.get(name, None) for name in _KINDS]
    filled = [pa.nulls(n, kind) if a is None else a.cast(kind) for a, kind in zip(arrays, _KINDS.values())]
    return pa.RecordBatch.from_arrays(filled, list(_KINDS))


def _answer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one chunk with the counts of their links."""
    kind = docs["kind"].to_numpy()
    plan = np.frombuffer(docs["data"][int(np.flatnonzero(kind == PLAN)[0])].as_py(), np.uint32).astype(np.int64)
    n_links, place = plan[1 : plan[0] + 1], plan[plan[0] + 1 :]
    count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers["place"].to_numpy()
    count[at], best[at] = answers["n"].to_numpy(), answers["is_best"].to_numpy(zero_copy_only=False)
    piece = np.repeat(np.arange(len(n_links)), n_links)
    # Whole numbers below 2^53 are exact as weights; sums of counts are added as integers.
    best_of = np.bincount(piece, best[place], len(n_links)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(count[place])])
    stops = np.cumsum(n_links)
    count_of = ends[stops] - ends[stops - n_links]
    rows = docs.filter(pa.array(kind == DOC))
    used = [np.frombuffer(d, np.uint32) for d in rows["data"].to_pylist()]
    n_best = [int(best_of[u].sum()) for u in used]
    total = [int(count_of[u].sum()) for u in used]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = [rows[c] for c in columns] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), rows["groups_sha256"], rows["groups"]]
    return pa.Table.from_arrays(out, [*columns, "n_best", "count_sum", "groups_sha256", "groups"])


def align_texts(df: DataFrame, pair: Pair, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per document: tokens of A and B, groups, links, links with the highest count of their B id, summed counts.

    ``groups_sha256`` digests the groups; ``groups`` holds their text if asked for.
    """
    staged = stage_table(only(df, doc_id=key, text=text).mapInArrow(_align(pair, keep_groups), STAGED), "aligned")
    asked = staged.where(F.col("kind") == ASKED).select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "pair"))
    asked = asked.select("chunk", "place", F.col("pair.pairs").alias("pair"), F.col("pair.counts").alias("n"))
    totals = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    totals = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    # One row per id of B: as many as its vocabulary has.
    highest = totals.groupBy("b").agg(F.max("n").alias("highest"))
    judged = totals.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    answers = asked.join(judged.withColumnRenamed("n", "total"), "pair").select(F.col("chunk").alias("asker"), "place", F.col("total").alias("n"), "is_best")
    docs = staged.where(F.col("kind") != ASKED).drop("pairs", "counts")
    return docs.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(_answer, ALIGNED)
