"""Operator 1: near-duplicate documents by MinHash.

1. Each task turns texts into sets of word shingles, their minima, and band keys.
   Documents of equal sets form a class at once (exact copies, however many).
2. Classes that share a band key are candidates. In every bucket one hub meets all
   others: as many pairs as members, not their square. The hub is the member
   whose buckets are fullest, which in a group of edited copies is one near the
   common original.
3. Pairs pass a check of signatures, then of the full sets in integers.
4. Links become components by alternating large-star and small-star.
5. Buckets of three or more that still hold several components have pairs that were not
   met. Their members are finished exactly: a similar pair must share one of the
   rarest shingles of both (the share of a set that the threshold lets differ,
   plus one), early enough in the order of rarity that what follows can suffice;
   only members with such a shingle in common are compared, across components. An edited copy whose edits leave it similar to nobody
   has none in common with anybody.

With 40 bands of 5 minima a pair at the threshold of 0.8 shares no bucket with
probability 1e-7; the signature check cuts seven deviations below the threshold.

Defined cases: a null or empty text has an empty set and is linked with nothing;
fewer words than a shingle make the whole sequence one shingle; rows repeating
an id are one document and get the same component; a row without an id is
linked with nothing, has no component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.components import components
from haulcast.llm.minhash import MinHash, set_digest
from haulcast.llm.tables import only
from haulcast.llm.words import STEP, grams, run_hash, signed, steps, words_of
from haulcast.staging import stage_table

HASHES = MinHash(bands=40, rows=5)

#: Texts of an Arrow column to one set of 64-bit numbers each.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def word_shingles(n: int) -> Sets:
    """Distinct runs of ``n`` words (ASCII letters lower-cased)."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        words = words_of(column)
        found, at = grams(words, n)
        doc = words.doc[at]
        places = np.searchsorted(doc, np.arange(len(column) + 1))
        bounds = words.bounds
        for i in range(len(column)):
            size = bounds[i + 1] - bounds[i]
            if size >= n:
                yield np.unique(found[places[i] : places[i + 1]])
            elif size:
                yield run_hash(words.hash[bounds[i] : bounds[i + 1]], 1, int(size))
            else:
                yield np.zeros(0, np.uint64)

    return sets


def sketch(df: DataFrame, sets: Sets, hashes: MinHash) -> DataFrame:
    """(id, n, set_a, set_b, signature, bands) of frame (id, text); signature and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sizes, digests, rows = [], [], []
            for elements in sets(batch.column("text")):
                sizes.append(len(elements))
                if len(elements):
                    digests.append(set_digest(elements))
                    rows.append(hashes.minima(elements))
            n = np.array(sizes, np.int64)
            full = n > 0
            signatures = np.array(rows, np.uint32).reshape(-1, hashes.size)
            keys = signed(hashes.band_keys(signatures)).reshape(-1)
            both = np.zeros((len(n), 2), np.uint64)
            both[full] = np.array(digests, np.uint64).reshape(-1, 2)
            short = signatures.astype(np.uint16)
            ends = np.concatenate([[0], np.cumsum(full)])
            none = pa.array(~full)
            packed = pa.Array.from_buffers(
                pa.binary(), len(n), [_valid(full), pa.py_buffer((ends * 2 * hashes.size).astype(np.int32)), pa.py_buffer(short)]
            )
            lists = pa.ListArray.from_arrays(pa.array((ends * hashes.bands).astype(np.int32)), pa.array(keys), mask=none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(signed(both[:, 0].copy())), pa.array(signed(both[:, 1].copy())), packed, lists],
                names=["id", "n", "set_a", "set_b", "signature", "bands"],
            )

    return df.mapInArrow(run, "id long, n long, set_a long, set_b long, signature binary, bands array<long>")


def _valid(mask: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(mask, bitorder="little"))


def _agreeing(pairs: DataFrame, reps: DataFrame, hashes: MinHash, percent: int) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity."""
    least = hashes.least_agreement(percent / 100)
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    near = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, hashes.size) for c in ("s_a", "s_b")
            ]
            equal = (sides[0] == sides[1]).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(equal))

    joined = pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def full_sets(df: DataFrame, sets: Sets, limit: int = STEP) -> DataFrame:
    """(id, elements) of frame (id, text): the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", limit):
            found = pa.array([x.tobytes() for x in sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "elements"])

    return df.mapInArrow(run, "id long, elements binary")


def similar(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(first) > len(second):
        first, second = second, first
    if not len(first):
        return False
    at = np.searchsorted(second, first)
    at[at == len(second)] = 0
    shared = int((second[at] == first).sum())
    return 100 * shared >= percent * (len(first) + len(second) - shared)


def confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar, as edges (u, v)."""
    one = whole.select(F.col("id").alias("a"), F.col("elements").alias("e_a"))
    two = whole.select(F.col("id").alias("b"), F.col("elements").alias("e_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("e_a"), batch.column("e_b"))
            ]
            edges = [batch.column("a"), batch.column("b")]
            yield pa.RecordBatch.from_arrays(edges, names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "e_a", "e_b").mapInArrow(run, "u long, v long")


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """Rows (key, id) of buckets with several members, with the members' number ``size``."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return buckets.join(sizes, "key")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """In each bucket its hub with every other member."""
    fullest = shared.groupBy("id").agg(F.sum("size").alias("rank"))
    ranked = shared.join(fullest, "id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("id"))).alias("hub"))
    met = shared.join(hubs.select("key", (-F.col("hub.id")).alias("hub")), "key").where("id <> hub")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def open_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the members of buckets that hold pairs of different components no hub has met."""
    inside = shared.where("size > 2").join(roots, shared["id"] == roots["node"], "left")
    inside = inside.select("key", "id", F.coalesce("root", "id").alias("root"))
    several = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return inside.join(several.select("key"), "key", "left_semi").select("id", "root").distinct()


def rarest(whole: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, place): the rarest elements of each set, as many as ``percent`` lets differ and one; only those in several sets.

    ``place`` is the element's place (from 1) in its set, in one order of elements for all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, blob in zip(batch.column("id"), batch.column("elements")):
                keys = pa.array(np.frombuffer(blob.as_buffer(), np.int64))
                for at in range(0, len(keys), 1 << 16):
                    piece = keys.slice(at, 1 << 16)
                    columns = [piece, pa.repeat(id_, len(piece)), pa.repeat(pa.scalar(len(keys), pa.int64()), len(piece))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n"])

    elements = whole.mapInArrow(run, "key long, id long, n long")
    common = elements.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = elements.join(common, "key")
    mine = Window.partitionBy("id")
    # Elements of one set only come first in the order and need no row of their own.
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "key"))
    least = F.ceil(F.col("n") * percent / 100)
    return held.withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1).select("key", "id", "n", "place")


def open_pairs(rare: DataFrame, members: DataFrame, percent: int, parity: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) of different components that can be similar, without those inside an element's largest component.

    Similar sets have a first common element, in the order of ``place``; all further ones stand after it in both.
    ``parity`` names columns of words of which each element after ``place`` flips one bit. At the first common element all
    earlier ones differ, and of the later ones no fewer than bits; further common elements need not let the pair pass.
    """
    inside = stage_table(rare.join(members, "id"), "rare")
    sizes = inside.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("roots"))
    mixed = inside.join(largest.where("roots > 1").drop("roots"), "key")
    one = mixed.where("root <> largest").select(
        "key", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("place").alias("px"),
        *[F.col(c).alias(f"{c}_x") for c in parity],
    )
    two = mixed.select(
        "key", F.col("id").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("place").alias("py"), "largest",
        *[F.col(c).alias(f"{c}_y") for c in parity],
    )
    across = F.expr("rx <> ry and (ry = largest or x < y)")
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    enough = most * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    met_if = (one["key"] == two["key"]) & across & enough
    if parity:
        differ = reduce(add, (F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in parity))
        # Of u in the union at most u * (100 - percent) / 100 differ, and the sizes sum to u and what is shared.
        differ += F.col("px") + F.col("py") - 2
        met_if &= differ * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    met = one.join(two, met_if)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_classes(docs: DataFrame, sets: Sets, hashes: MinHash, percent: int) -> DataFrame:
    """(id, n, component) of frame (id, text) without null ids; component is null for empty sets."""
    rows = stage_table(sketch(docs, sets, hashes), "sketch")
    classes = rows.where("n > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    own = rows.select("id", "n", "set_a", "set_b")
    member = stage_table(own.join(classes, ["set_a", "set_b"], "left").select("id", "n", "rep"), "member")
    chosen = member.where("rep = id").select("id").distinct()
    reps = rows.where("n > 0").join(chosen, "id", "left_semi")
    shared = stage_table(shared_buckets(reps.select(F.explode("bands").alias("key"), "id")), "buckets")
    near = stage_table(_agreeing(hub_pairs(shared), reps, hashes, percent), "near-pairs")
    # Texts of all bucket members are fetched once. Their ids grow with the rows, so they are never broadcast.
    wanted = shared.select("id").distinct().hint("merge")
    whole = stage_table(full_sets(docs.join(wanted, "id", "left_semi"), sets), "sets")
    found = stage_table(confirmed(near, whole, percent), "links")
    # A repeated id whose rows have different texts ties their classes together.
    several = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    ties = several.join(member, "id").select(F.col("low").alias("u"), F.col("rep").alias("v"))
    roots = stage_table(components(found.unionAll(ties)), "roots")
    left = stage_table(open_members(shared, roots), "open")
    if not left.isEmpty():
        rest = open_pairs(rarest(whole.join(left.select("id"), "id", "left_semi"), percent), left, percent)
        more = stage_table(confirmed(rest, whole, percent), "links")
        if not more.isEmpty():
            stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = stage_table(components(stars.unionAll(more)), "roots")
    return member.join(roots, member["rep"] == roots["node"], "left").select(
        "id", "n", F.coalesce("root", "rep").alias("component")
    )


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, hashes: MinHash = HASHES
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; linked are documents with 100 * shared >= percent * union."""
    named = only(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    found = linked_classes(named.where("id is not null"), word_shingles(words), hashes, percent)
    own = found.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    lost = sketch(named.where("id is null"), word_shingles(words), hashes)
    nameless = lost.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return own.unionAll(nameless).withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(key)))
