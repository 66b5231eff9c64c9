"""Operator 6: license scans by diagonal voting.

All runs of ``GRAM`` words of every text are joined to the runs of the license
texts. A hit at word p of a document and word q of a template votes for the
diagonal p - q: a copy puts all its votes on one diagonal, and an added or
dropped word moves the rest to a neighbouring one. Votes are aggregated per
document, template and diagonal; neighbouring diagonals are merged into a
candidate span; a span is verified by the longest chain of hits that rises in
document and template alike, its share of the template being the score. Of
overlapping spans the best stays.

A phrase is found exactly where its diagonal holds every one of its votes.

Defined cases: a null or empty text has no words and no labels; rows repeating
an id with the same text get the same result, with other texts their own; ties of
spans go to the longer, then the earlier template. Texts are never cut. The
template table is fixed and a few hundred rows long, so it is broadcast. A run
of words that half of all documents contain only adds rows of its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.license_texts import NOTICES, PHRASES
from haulcast.llm.substrings import text_mark
from haulcast.llm.tables import only
from haulcast.llm.words import LOWER, NOT_ALNUM, Words, grams, signed, steps, words_of

GRAM = 3
#: Diagonals this near belong to one span: so many words may be added or dropped in a row.
NEAR = 4
#: Share of the template that a chain must cover.
VERIFIED = 0.8

Templates = Sequence[tuple[str, str]]


def _words(column: pa.Array) -> Words:
    return words_of(column, NOT_ALNUM, LOWER)


def template_grams(templates: Templates) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every run of words of the templates."""
    words = _words(pa.array([text for _, text in templates]))
    if (np.diff(words.bounds) < GRAM).any():
        raise ValueError(f"a template needs {GRAM} words at least")
    found, at = grams(words, GRAM)
    doc = words.doc[at]
    return list(zip(signed(found).tolist(), doc.tolist(), (at - words.bounds[doc]).tolist()))


@cache
def template_sizes(templates: Templates) -> list[int]:
    return np.diff(_words(pa.array([text for _, text in templates])).bounds).tolist()


def gram_rows(named: DataFrame) -> DataFrame:
    """(id, mark, place, gram) of every run of words of frame (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = _words(batch.column("text"))
            found, at = grams(words, GRAM)
            doc = words.doc[at]
            columns = [
                batch.column("id").take(pa.array(doc)),
                pa.array(signed(text_mark(words))[doc]),
                pa.array((at - words.bounds[doc]).astype(np.int32)),
                pa.array(signed(found)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "place", "gram"])

    return named.mapInArrow(run, "id long, mark long, place int, gram long")


def word_counts(named: DataFrame) -> DataFrame:
    """(id, mark, n_words) of every row of frame (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = _words(batch.column("text"))
            columns = [batch.column("id"), pa.array(signed(text_mark(words))), pa.array(np.diff(words.bounds))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n_words"])

    return named.mapInArrow(run, "id long, mark long, n_words long")


def diagonal_votes(named: DataFrame, templates: Templates) -> DataFrame:
    """(id, mark, template, diagonal, places): places in the document that vote for the diagonal, in order."""
    spark = named.sparkSession
    table = spark.createDataFrame(template_grams(templates), "gram long, template int, at int")
    hits = gram_rows(named).join(F.broadcast(table), "gram")
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    return hits.groupBy("id", "mark", "template", diagonal).agg(F.sort_array(F.collect_set("place")).alias("places"))


def longest_chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place, at), sorted, in which both rise."""
    ends: list[int] = []  # index of the hit that ends the best chain of each length
    back = [-1] * len(hits)
    for i, (_, at) in enumerate(hits):
        low, high = 0, len(ends)
        while low < high:
            middle = (low + high) // 2
            if hits[ends[middle]][1] < at:
                low = middle + 1
            else:
                high = middle
        back[i] = ends[low - 1] if low else -1
        ends[low : low + 1] = [i]
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(hits[i])
        i = back[i]
    return chain[::-1]


def spans(votes: list[tuple[int, list[int]]], size: int) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of the verified spans of one template; ``votes``: (diagonal, places)."""
    out, band = [], []
    for diagonal, places in [*sorted(votes), (None, [])]:
        if band and (diagonal is None or diagonal - band[-1][0] > NEAR):
            hits = sorted({(p, p - d) for d, ps in band for p in ps})
            chain = longest_chain(_one_per_place(hits))
            covered = {at + j for _, at in chain for j in range(GRAM)}
            first, last = chain[0][0], chain[-1][0] + GRAM - 1
            score = len(covered) / max(size, last - first + 1)
            if score >= VERIFIED:
                out.append((first, last, score))
            band = []
        band.append((diagonal, places))
    return out


def _one_per_place(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of hits at one place the later template words first, so that a chain takes one of them."""
    return sorted(hits, key=lambda x: (x[0], -x[1]))


def best_spans(found: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """Spans (first, last, score, template) without those that a better one overlaps."""
    kept: list[tuple[int, int, float, int]] = []
    for span in sorted(found, key=lambda s: (-s[2], s[0] - s[1], s[3], s[0])):
        if all(span[1] < k[0] or span[0] > k[1] for k in kept):
            kept.append(span)
    return sorted(kept)


_SPAN = "array<struct<label:string,first:long,last:long,score:double>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", phrases: Templates = PHRASES, notices: Templates = NOTICES
) -> DataFrame:
    """(key, n_words, phrases, notices) of every row: exact phrase places and verified notice spans, as arrays of spans."""
    templates = (*phrases, *notices)
    sizes = template_sizes(templates)
    named = only(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    votes = diagonal_votes(named, templates)
    # A diagonal of a notice is kept with any vote; one of a phrase counts when complete.
    by_doc = votes.groupBy("id", "mark").agg(F.collect_list(F.struct("template", "diagonal", "places")).alias("votes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, near = [], []
            for rows in batch.column("votes").to_pylist():
                places, found, split = [], [], {}
                for r in rows:
                    t = r["template"]
                    if t >= len(phrases):
                        split.setdefault(t, []).append((r["diagonal"], r["places"]))
                    elif len(r["places"]) == sizes[t] - GRAM + 1:
                        places.append((r["diagonal"], r["diagonal"] + sizes[t] - 1, 1.0, t))
                for t, one in split.items():
                    found += [(*s, t) for s in spans(one, sizes[t])]
                exact.append([_span(s, templates) for s in sorted(places)])
                near.append([_span(s, templates) for s in best_spans(found)])
            columns = [batch.column("id"), batch.column("mark"), pa.array(exact, _SPAN_TYPE), pa.array(near, _SPAN_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "phrases", "notices"])

    found = by_doc.mapInArrow(run, f"id long, mark long, phrases {_SPAN}, notices {_SPAN}")
    found = found.select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "phrases", "notices")
    rows = word_counts(named)
    joined = rows.join(found, rows["id"].eqNullSafe(found["id_"]) & (rows["mark"] == found["mark_"]), "left")
    none = F.array().cast(_SPAN)
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce("phrases", none).alias("phrases"),
        F.coalesce("notices", none).alias("notices"),
    )


def _span(span: tuple[int, int, float, int], templates: Templates) -> dict[str, object]:
    return {"label": templates[span[3]][0], "first": span[0], "last": span[1], "score": span[2]}
