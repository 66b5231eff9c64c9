"""Operator 5: fuzzy line dedup by MinHash.

1. Every line is lower-cased and its white space joined; equal lines are one
   class, known by a hash. A task hashes and sends each class of its load once.
2. The minima of a line's character shingles make band keys, which go to buckets
   in packed form; buckets report keys that several classes share.
3. In each shared bucket one hub meets the others; texts of the classes met are
   fetched once, and pairs are confirmed on their full shingle sets; bits of the
   lines rule out most other pairs before.
4. Confirmed pairs become components by union-find: a forest inside each task,
   then alternating stars between tasks. What buckets left open is finished
   exactly, as in operator 1, by a shared order of shingles that is about the rarest first;
   bits of the shingles that follow rule out most pairs inside the join.
5. Of each component the earliest line (smallest document id, then line number)
   stays; all others, exact copies included, go.

With 12 bands of 4 minima a pair at the threshold of 0.8 shares no bucket with
probability 0.002 (for a pair of similarity 0.9: 3e-6).

Defined cases: null and empty texts have no lines; lines without a word are never
counted, linked or removed; a line shorter than a shingle is one shingle; a row
without an id comes after all others and is judged on its own lines only with the
smaller places first; rows repeating an id with the same text are one document and
get the same result; texts are never cut; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.components import components
from haulcast.llm.decontaminate import summed
from haulcast.llm.minhash import MinHash
from haulcast.llm.neardup import hub_pairs, open_members, open_pairs
from haulcast.llm.substrings import NULL_ID, _packed, _unpacked, bucket_of
from haulcast.llm.tables import only, spread
from haulcast.llm.words import KEEP_CASE, bytes_of, signed, span_hash, span_hash_bytes, steps, strings, text_buffer, window_sums, words_of
from haulcast.staging import stage_table

SHINGLE = 8
PERCENT = 80
HASHES = MinHash(bands=12, rows=4, seed=5)
#: Shingles hashed at once, so that they stay in the processor's cache.
CHUNK = 1 << 14
LOAD = 12 << 20
#: Bytes of text taken at once.
STEP = 1 << 20
#: Places that count shingles together. They only order the shingles: any order finds the same pairs, a good one meets few others.
RARITY_BITS = 22
#: Bits that tell apart most lines which are not similar, before their sets are compared.
MARKS = 1 << 11
#: Words of the same for the exact finish: a bit tells whether the shingles after a place of the order that stand for it are odd in number.
PARITY = [f"odd{i}" for i in range(4)]


class Lines:
    """Lines with a word of a batch of texts, normalised: lower case, single blanks, trimmed."""

    def __init__(self, column: pa.Array) -> None:
        words = words_of(pc.utf8_lower(column), fold=KEEP_CASE)
        breaks = np.zeros(len(words.codes) + 1, np.int32)
        np.cumsum(words.codes == 0x0A, dtype=np.int32, out=breaks[1:])
        number = breaks[words.start] - breaks[words.offsets[:-1]][words.doc]
        new = np.ones(len(words.start), bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (number[1:] != number[:-1])
        self.words, self.first = words, np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(new)) - 1 if len(new) else self.first
        self.doc, self.number = words.doc[self.first], number[self.first]
        self.n = np.bincount(self.doc, minlength=len(column))
        self.hash = span_hash(words.hash, self.first, self.last + 1)

    def text(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of some lines, words joined by one blank."""
        w, first, last = self.words, self.first[lines], self.last[lines]
        many = last - first + 1
        at = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        stop = w.end[at] + 1
        closing = np.cumsum(many) - 1
        stop[closing] -= 1
        out, offsets = bytes_of(w.codes, w.start[at], stop)
        inner = np.ones(len(at), bool)
        inner[closing] = False
        out[offsets[1:][inner] - 1] = 0x20
        return out, np.append(0, offsets[1:][closing])


def _text_marks(column: pa.Array) -> np.ndarray:
    codes, offsets = text_buffer(column)
    return span_hash_bytes(codes, offsets[:-1], offsets[1:])


#: A random number per character, the same in every task.
_VALUES = np.random.default_rng(77).integers(1, 1 << 64, 1 << 16, dtype=np.uint64)


def shingles(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE characters of the lines, none of them empty, and where each line's begin."""
    lead = (codes & 0xC0) != 0x80
    chars = np.frombuffer(codes.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sizes = np.add.reduceat(lead, offsets[:-1], dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(sizes))
    starts = np.append(0, np.cumsum(np.maximum(sizes - SHINGLE + 1, 1)))
    return window_sums(_VALUES[chars & 0xFFFF] + (chars >> 16), ends, SHINGLE), starts


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Shingle set of each normalised line; lines that occur several times share one."""
    coded = column.dictionary_encode()
    found, starts = shingles(*text_buffer(coded.dictionary))
    sets = [np.unique(found[low:high]) for low, high in zip(starts[:-1], starts[1:])]
    return [sets[i] for i in coded.indices.to_pylist()]


def _overlap(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sets that are sorted and not empty."""
    union = np.concatenate([first, second])
    union.sort()
    shared = int((union[1:] == union[:-1]).sum())
    return 100 * shared >= percent * (len(union) - shared)


def minima(found: np.ndarray, starts: np.ndarray, hashes: MinHash) -> np.ndarray:
    """Signatures of many sets that lie one after the other, in pieces of about CHUNK shingles."""
    a, b = hashes._family
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, hashes.size), np.uint32)
    at = 0
    while at < len(starts) - 1:
        end = max(int(np.searchsorted(starts, starts[at] + CHUNK, "right")) - 1, at + 1)
        piece, cuts = x[starts[at] : starts[end]], starts[at:end] - starts[at]
        for k in range(hashes.size):
            out[at:end, k] = np.minimum.reduceat(a[k] * piece + b[k], cuts)
        at = end
    return out


#: A bucket is part of the key, so half of the key tells apart what it holds; a rare clash is one candidate more.
_KEYS = pa.schema([("key", pa.int32()), ("id", pa.int64())])


def line_table(named: DataFrame, hashes: MinHash, buckets: int) -> DataFrame:
    """Two kinds of rows from one reading of frame (id, text).

    (id, mark, numbers, lines): hashes of each row's lines and their numbers.
    (bucket, keys), the others null: packed band keys of the distinct lines of a load.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        known: set[int] = set()

        def blobs() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            key = np.concatenate(keys).reshape(-1)
            id_ = np.repeat(np.concatenate(ids), hashes.bands)
            bucket = bucket_of(key, buckets)
            key = (key >> 32).astype(np.int32)
            order = np.lexsort((key, bucket))
            key, id_, bucket = key[order], id_[order], bucket[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            parts = [pa.table([pa.array(key[a:b]), pa.array(id_[a:b])], schema=_KEYS) for a, b in zip(cut[:-1], cut[1:])]
            yield _line_rows(len(parts), bucket=pa.array(bucket[cut[:-1]]), keys=pa.array([_packed(x) for x in parts], pa.binary()))

        for batch in steps(batches, "text", STEP):
            lines = Lines(batch.column("text"))
            ends = pa.array(np.append(0, np.cumsum(lines.n)).astype(np.int32))
            yield _line_rows(
                batch.num_rows,
                id=batch.column("id"),
                mark=pa.array(signed(_text_marks(batch.column("text")))),
                numbers=pa.ListArray.from_arrays(ends, pa.array(lines.number.astype(np.int32))),
                lines=pa.ListArray.from_arrays(ends, pa.array(signed(lines.hash))),
            )
            id_, first = np.unique(signed(lines.hash), return_index=True)
            new = np.array([x not in known for x in id_.tolist()], bool)
            id_, first = id_[new], first[new]
            if len(id_):
                known.update(id_.tolist())
                codes, offsets = lines.text(first)
                keys.append(signed(hashes.band_keys(minima(*shingles(codes, offsets), hashes))))
                ids.append(id_)
            held += len(lines.words.codes)
            if held >= LOAD:
                yield from blobs()
                keys, ids, held = [], [], 0
                known.clear()
        yield from blobs()

    return named.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _LINE_ROWS.items()))


_LINE_ROWS = {"id": "long", "mark": "long", "numbers": "array<int>", "lines": "array<long>", "bucket": "long", "keys": "binary"}
_LINE_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.binary()]


def _line_rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of which some columns are given."""
    whole = [columns.get(name, pa.nulls(n, kind)) for name, kind in zip(_LINE_ROWS, _LINE_KINDS)]
    return pa.RecordBatch.from_arrays(whole, names=list(_LINE_ROWS))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, id, size): classes of lines that share a band key with another class, from packed rows (bucket, keys)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket = [], None
        for batch in batches:
            for at, blob in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                if at != bucket and parts:
                    yield _meeting(pa.concat_tables(parts), bucket)
                    parts = []
                bucket = at
                parts.append(_unpacked(blob))
        if parts:
            yield _meeting(pa.concat_tables(parts), bucket)

    met = rows.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(meet, "key long, id long, size long")


def _meeting(rows: pa.Table, bucket: int) -> pa.RecordBatch:
    """Distinct (key, id) of keys with several ids, the bucket in the key's upper half."""
    key, id_ = (rows[c].to_numpy() for c in ("key", "id"))
    key = (np.int64(bucket) << 32) | key.view(np.uint32).astype(np.int64)
    order = np.argsort(key)
    key, id_ = key[order], id_[order]
    same = key[1:] == key[:-1]
    several = np.append(False, same) | np.append(same, False)
    key, id_ = key[several], id_[several]
    order = np.lexsort((id_, key))
    key, id_ = key[order], id_[order]
    new = np.append(True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))[: len(key)]
    key, id_ = key[new], id_[new]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    size = n[back]
    several = size > 1
    columns = [pa.array(key[several]), pa.array(id_[several]), pa.array(size[several])]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "size"])


def forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v) reduced inside each task to a forest: every node points at the smallest node it is known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _marked(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """MARKS bits of each line, those at the places of its shingles."""
    blobs = []
    for at in range(0, len(offsets) - 1, 1 << 10):
        ends = offsets[at : at + (1 << 10) + 1]
        found, starts = shingles(codes[ends[0] : ends[-1]], ends - ends[0])
        bits = np.zeros((len(ends) - 1, MARKS), bool)
        bits[np.repeat(np.arange(len(ends) - 1), np.diff(starts)), (found >> np.uint64(32)) % np.uint64(MARKS)] = True
        blobs += map(bytes, np.packbits(bits, axis=1))
    return pa.array(blobs, pa.binary())


def may_be_similar(batch: pa.RecordBatch, percent: int) -> np.ndarray:
    """Whether the bits of two lines allow the similarity. Lines that differ in d shingles differ in d bits at most."""
    if not batch.num_rows:
        return np.zeros(0, bool)
    bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, MARKS // 64) for c in ("m_a", "m_b")]
    differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
    size = [np.maximum(pc.utf8_length(batch.column(c)).to_numpy() - SHINGLE + 1, 1) for c in ("t_a", "t_b")]
    # Of u in the union at most u * (100 - percent) / 100 differ, and the sizes sum to u and what is shared.
    return differ * (100 + percent) <= (100 - percent) * (size[0].astype(np.int64) + size[1])


def _class_texts(named: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, marks) of classes: each normalised line once with its bits, read from the first row that has it."""
    at = F.struct("doc", "mark", "number")
    first = lines.join(wanted, lines["line"] == wanted["id"]).groupBy("id").agg(F.min(at).alias("at"))
    places = first.groupBy(F.col("at.doc").alias("doc_")).agg(F.collect_list(F.struct("id", "at.mark", "at.number")).alias("places"))
    keyed = named.select(F.coalesce("id", F.lit(int(NULL_ID))).alias("doc_"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            found = Lines(batch.column("text"))
            marks = signed(_text_marks(batch.column("text")))
            at = {(d, n): i for i, (d, n) in enumerate(zip(found.doc.tolist(), found.number.tolist()))}
            ids, index = [], []
            for doc, places in enumerate(batch.column("places").to_pylist()):
                for place in places:
                    if place["mark"] == marks[doc]:
                        ids.append(place["id"])
                        index.append(at[doc, place["number"]])
            index = np.array(index, np.int64)
            codes, offsets = found.text(index)
            columns = [pa.array(ids, pa.int64()), strings(codes, offsets), _marked(codes, offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "marks"])

    return keyed.join(places, "doc_").select("text", "places").mapInArrow(run, "id long, text string, marks binary")


def confirmed_lines(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar, as edges (u, v). Texts travel: they are an eighth of their sets.

    The sets are compared where the bits of the lines leave it open.
    """
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"), F.col("marks").alias("m_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"), F.col("marks").alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t_a", STEP // 4):
            batch = batch.filter(pa.array(may_be_similar(batch, percent)))
            sides = zip(_sets(batch.column("t_a")), _sets(batch.column("t_b")))
            keep = [_overlap(x, y, percent) for x, y in sides]
            edges = [batch.column("a"), batch.column("b")]
            yield pa.RecordBatch.from_arrays(edges, names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "t_a", "t_b", "m_a", "m_b").mapInArrow(run, "u long, v long")


def parity_after(found: np.ndarray, line: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """For each shingle that is sent, words of bits of its line's shingles after it, one row per word.

    A shingle flips one bit, so that what follows in two lines differs in no fewer shingles than bits.
    """
    bit = (found >> np.uint64(32)) % np.uint64(64 * len(PARITY))
    flips = np.zeros((len(PARITY), len(found)), np.uint64)
    flips[(bit >> np.uint64(6)).astype(np.intp), np.arange(len(found))] = np.uint64(1) << (bit & np.uint64(63))
    seen = np.bitwise_xor.accumulate(flips, axis=1)
    last = np.searchsorted(line, line[sent], "right") - 1
    return (seen[:, last] ^ seen[:, sent]).view(np.int64)


def first_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, place, PARITY): the first shingles of each line, as many as ``percent`` lets differ and one, about the rarest first.

    ``place`` is the shingle's place (from 1) in its line's set of ``n``, in one order of shingles for all lines; PARITY is of those after it.
    """
    shift = np.uint64(64 - RARITY_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(1 << RARITY_BITS)
        for batch in steps(batches, "text", STEP):
            found, _ = shingles(*text_buffer(batch.column("text")))
            np.add.at(seen, (found >> shift).astype(np.intp), 1.0)
        return seen

    often = summed(texts, count, 1 << RARITY_BITS).clip(0, 2**32 - 1).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            found, starts = shingles(*text_buffer(batch.column("text")))
            line = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            order = np.lexsort((found, often[(found >> shift).astype(np.intp)], line))
            found, line = found[order], line[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (line[1:] != line[:-1])
            found, line = found[new], line[new]
            size = np.bincount(line, minlength=batch.num_rows)
            place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + 1
            least = -(-size * percent // 100)
            sent = place <= (size - least + 1)[line]
            odd = parity_after(found, line, sent)
            found, line, place = found[sent], line[sent], place[sent]
            columns = [pa.array(signed(found)), batch.column("id").take(pa.array(line)), pa.array(size[line]), pa.array(place)]
            columns += [pa.array(word) for word in odd]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "place", *PARITY])

    return texts.mapInArrow(run, ", ".join(f"{name} long" for name in ["key", "id", "n", "place", *PARITY]))


def line_components(named: DataFrame, lines: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the line classes that are similar to another one."""
    shared = stage_table(shared_keys(keys), "line-buckets")
    texts = stage_table(_class_texts(named, lines, shared.select("id").distinct()), "line-texts")
    found = confirmed_lines(hub_pairs(shared), texts, percent)
    roots = stage_table(components(forests(found)), "line-roots")
    left = stage_table(open_members(shared, roots), "line-open")
    if not left.isEmpty():
        some = stage_table(texts.join(left.select("id"), "id", "left_semi").dropDuplicates(["id"]), "line-rest")
        rare = first_shingles(some, percent)
        more = stage_table(confirmed_lines(open_pairs(rare, left, percent, PARITY), texts, percent), "line-links")
        if not more.isEmpty():
            stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = stage_table(components(forests(stars.unionAll(more))), "line-roots")
    return roots


def judge_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    hashes: MinHash = HASHES,
    buckets: int | None = None,
) -> DataFrame:
    """(key, mark, n_lines, removed): lines with a word of every row, and the numbers (from 0) of those to remove."""
    named = only(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    found = stage_table(line_table(named, hashes, buckets or 4 * spread(df)), "lines")
    rows, keys = found.where("bucket is null").drop("bucket", "keys"), found.where("bucket is not null").select("bucket", "keys")
    one = rows.select(
        F.coalesce("id", F.lit(int(NULL_ID))).alias("doc"), "mark", F.explode(F.arrays_zip("numbers", "lines")).alias("x")
    ).select("doc", "mark", F.col("x.numbers").alias("number"), F.col("x.lines").alias("line"))
    roots = line_components(named, one, keys, percent)
    placed = one.join(roots, one["line"] == roots["node"], "left").withColumn("root", F.coalesce("root", "line"))
    first = placed.groupBy("root").agg(F.min(F.struct("doc", "number")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = placed.join(first, "root").where(F.struct("doc", "number") != F.col("first"))
    gone = later.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("number")).alias("removed"))
    out = rows.select("id", F.coalesce("id", F.lit(int(NULL_ID))).alias("doc"), "mark", F.size("lines").cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return out.join(gone, ["doc", "mark"], "left").select(
        F.col("id").alias(key), "mark", "n_lines", F.coalesce("removed", none).alias("removed")
    )


def remove_lines(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with the removed lines cut out of its text."""
    found = judge_lines(df, key, text, percent).select(F.col(key).alias("__key"), "mark", "removed").distinct()

    names, place = df.columns, df.columns.index(text)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            mark = pa.array(signed(_text_marks(batch.column(place))))
            yield pa.RecordBatch.from_arrays([*batch.columns, mark], names=[*names, "__mark"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    marked = df.mapInArrow(marks, f"{schema}, __mark long")
    same = marked[key].cast("long").eqNullSafe(found["__key"]) & (marked["__mark"] == found["mark"])
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i))
    cut = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    return marked.join(found, same, "left").withColumn(text, cut).select(*df.columns)
