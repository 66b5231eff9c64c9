"""Operator 4: main text of pages by template deduction over the pages of a host.

1. Every page becomes tokens: tags in their context and whole text blocks. For
   each host and token an occurrence vector (how often on which page) is summed up
   as a fingerprint, added up by partial sums, so no host gathers in a task.
2. Tokens of a host with equal vectors form an equivalence class. Classes on
   enough pages are candidates.
3. A class is valid if its tokens stand in the same order, as often as its vector
   says, on every page, and if it nests with every larger class: on each page the
   occurrences of one lie between neighbouring tokens of the other. Two classes that
   interleave in one and the same way on all pages have tokens that differ by their
   place alone, parts of one class when told apart, and both stay; else the smaller
   one is chance. Pages check order and nesting and their votes are aggregated.
4. The largest valid class that occurs once on each page is the root of the
   template; its tokens cut a page into slots, and the other valid classes nest in
   them. Text of template tokens is no content. Of the remaining slots those of
   the article are extracted: what stands in an article or main element, else all
   text but menus of links, never what an element or its class names as menu,
   header, footer, sidebar, notice, advert, form or comments.

Text that a valid class holds inside an article element stays unless all of it is
link text: pages of a host may be copies of each other. A form that holds a page's
structure (an article, a main heading, navigation) only frames it. A name says that an
element is outside if all its words do, or name parts of a page.

Defined cases: null and empty pages have no text; pages without an address share
the empty host; a host of fewer than MIN_PAGES pages has no template and its pages
are read by their elements alone; repeated pages count as pages; broken
and cut off markup is read as far as it goes; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.page_parse import Block, Page, parse
from haulcast.llm.tables import only
from haulcast.llm.words import mix, steps
from haulcast.staging import stage_table

#: Pages of a host from which on its tokens are compared, and share of them that a class needs.
MIN_PAGES = 4
FREQUENT = 0.5
#: Tokens that make a class large enough to be more than chance.
MIN_TOKENS = 2


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, vector, pages, total) of frame (id, host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            seen: dict[tuple[str, int], list[int]] = {}
            hosts, ids = batch.column("host").to_pylist(), batch.column("mark").to_pylist()
            for host, mark, html in zip(hosts, ids, batch.column("html").to_pylist()):
                tokens, counts = np.unique(np.array(parse(html or "").tokens, np.int64), return_counts=True)
                prints = mix((counts.astype(np.uint64) << np.uint64(32)) ^ mix(np.full(len(counts), mark, np.int64).view(np.uint64)))
                # Sums of 40 bits stay within a long for 2**23 pages of a task.
                for token, count, p in zip(tokens.tolist(), counts.tolist(), (prints >> np.uint64(24)).tolist()):
                    entry = seen.setdefault((host, token), [0, 0, 0])
                    entry[0] += p
                    entry[1] += 1
                    entry[2] += count
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "vector", "pages", "total"])

    rows = pages.mapInArrow(run, "host string, token long, vector long, pages long, total long")
    return rows.groupBy("host", "token").agg(
        F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("pages").alias("pages"), F.sum("total").alias("total")
    )


def candidate_classes(pages: DataFrame) -> DataFrame:
    """(host, class, once, tokens): tokens of equal vectors on enough pages of their host."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    vectors = occurrence_vectors(pages).where("pages > 1")
    frequent = vectors.join(sizes, "host").where(F.col("pages") >= F.col("n") * FREQUENT)
    once = ((F.col("total") == F.col("n")) & (F.col("pages") == F.col("n"))).alias("once")
    classes = frequent.groupBy("host", "vector", "pages", "total", once).agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    number = F.xxhash64("vector", "pages", "total").alias("class")
    return classes.where(F.size("tokens") >= MIN_TOKENS).select("host", number, "once", "tokens")


def per_host(classes: DataFrame) -> DataFrame:
    """(host, classes): all classes of a host in one row, a few hundred tokens."""
    return stage_table(
        classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "once", "tokens"))).alias("classes")),
        "page-classes",
    ).withColumnRenamed("host", "host_")


def _with_classes(pages: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    return pages.join(classes, pages["host"] == classes["host_"], how).drop("host_")


def valid_classes(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates whose tokens keep one order on all pages of the host, and that nest with the larger ones that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            found: dict[tuple[str, int, int], list[int]] = {}
            marks: dict[tuple, dict[tuple[int, int], int]] = {}
            for host, html, classes in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "classes"))):
                tokens = parse(html or "").tokens
                owner = {t: c["class"] for c in classes for t in c["tokens"]}
                size = {c["class"]: len(c["tokens"]) for c in classes}
                mine = [token for token in tokens if token in owner]
                order: dict[int, list[int]] = {}
                for token in mine:
                    order.setdefault(owner[token], []).append(token)
                votes = {(c, c): _period(sequence, size[c]) for c, sequence in order.items()}
                # Pages of one layout have one answer.
                owners = tuple(c for c in map(owner.__getitem__, mine) if votes[c, c] >= 0)
                if (host, owners) not in marks:
                    marks[host, owners] = _nesting(owners, size)
                votes |= marks[host, owners]
                for (one, other), mark in votes.items():
                    entry = found.setdefault((host, one, other), [mark, mark])
                    entry[:] = min(entry[0], mark), max(entry[1], mark)
            keys = list(found)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            columns += [pa.array([found[k][i] for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "class", "larger", "low", "high"])

    voted = _with_classes(pages, per_host(candidates), "inner").mapInArrow(
        run, "host string, class long, larger long, low long, high long"
    )
    agreed = stage_table(
        voted.groupBy("host", "class", "larger").agg(F.min("low").alias("low"), F.max("high").alias("high")), "class-votes"
    )
    ordered = agreed.where("class = larger and low = high and low >= 0").select("host", "class")
    crossing = agreed.where("class != larger and low != high").select("host", "class", "larger")
    # Only a class that keeps its own order can speak against another.
    crossing = crossing.join(ordered.withColumnRenamed("class", "larger"), ["host", "larger"], "left_semi")
    return candidates.join(ordered, ["host", "class"]).join(crossing, ["host", "class"], "left_anti")


def _nesting(owners: tuple[int, ...], size: dict[int, int]) -> dict[tuple[int, int], int]:
    """Per pair (class, larger class) of a page's template tokens: 0 if they nest there, else a hash of how they interleave."""
    places: dict[int, list[int]] = {}
    for place, owner in enumerate(owners):
        places.setdefault(owner, []).append(place)
    ranked = sorted(places, key=lambda c: (size[c], c))
    out = {}
    for i, one in enumerate(ranked):
        for other in ranked[i + 1 :]:
            nests = _within(places[one], size[one], places[other]) or _within(places[other], size[other], places[one])
            out[one, other] = 0 if nests else 1 + (hash(tuple(o == one for o in owners if o in (one, other))) & 0x3FFFFFFFFFFFFFFF)
    return out


def _within(inner: list[int], size: int, outer: list[int]) -> bool:
    """Whether no token of ``outer`` stands inside an occurrence of the inner class."""
    return all(bisect_left(outer, inner[k]) == bisect_left(outer, inner[k + size - 1]) for k in range(0, len(inner), size))


def _period(sequence: list[int], size: int) -> int:
    """A hash of the order in which the class's tokens follow each other; -1 if it changes within the page."""
    first = sequence[:size]
    if len(sequence) % size or any(sequence[i : i + size] != first for i in range(size, len(sequence), size)):
        return -1
    return hash(tuple(first)) & 0x7FFFFFFFFFFFFFFF


def slots(page: Page, root: list[int]) -> list[int]:
    """Number of the root token before each block: blocks with one number share a slot of the template."""
    wanted, at, number, out = set(root), 0, 0, []
    for block in page.blocks:
        while at < block.token:
            number += page.tokens[at] in wanted
            at += 1
        out.append(number)
    return out


def main_text(page: Page, classes: list[dict]) -> str:
    """Blocks of the article in page order, joined by blanks."""
    template = {t for c in classes for t in c["tokens"]}
    roots = [c["tokens"] for c in classes if c["once"]]
    numbers = slots(page, max(roots, key=len) if roots else [])
    open_ = [(b, n) for b, n in zip(page.blocks, numbers) if not b.outside]
    article = [(b, n) for b, n in open_ if b.main]
    if article:
        # What an article element holds is the article, on a host of copies too, but for links that the template repeats.
        return " ".join(b.text for b, _ in article if b.plain or page.tokens[b.token] not in template)
    return " ".join(b.text for b in _running([(b, n) for b, n in open_ if page.tokens[b.token] not in template]))


def _running(found: list[tuple[Block, int]]) -> list[Block]:
    """Blocks with text that is no link, whatever their length, links between two of them, and no headings of links."""
    text = [block.plain for block, _ in found]
    prose = [t and not block.heading for t, (block, _) in zip(text, found)]
    kept: list[Block] = []
    headed = True
    for i in range(len(found) - 1, -1, -1):
        block = found[i][0]
        between = 0 < i < len(found) - 1 and prose[i - 1] and prose[i + 1]
        headed = (text[i] and (headed or not block.heading)) or between
        if headed:
            kept.append(block)
    return kept[::-1]


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page."""
    named = only(df, id=key, url=url, html=html)
    pages = named.select(
        "id", "url", host_of("url").alias("host"), F.xxhash64("id", "url", "html").alias("mark"), "html"
    )
    candidates = stage_table(candidate_classes(pages), "candidates")
    templates = per_host(valid_classes(pages, candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            rows = zip(batch.column("html").to_pylist(), batch.column("classes").to_pylist())
            text = [main_text(parse(html or ""), classes or []) for html, classes in rows]
            columns = [batch.column("id"), batch.column("url"), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text"])

    kind = dict(named.dtypes)["id"]
    out = _with_classes(pages.select("id", "url", "host", "html"), templates, "left")
    return out.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", key).withColumnRenamed("url", url)
