"""Token alignment against a merge of whole texts, document by document."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from haulcast.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PAIR = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

HARD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "  two  blanks   and\n\nlines\tand  wide 　ones. \n x  "),
    (5, "a literal ▁ mark is lost"),
    (6, "<|endoftext|> <s> </s> <unk> <0x41> as text"),
    (7, "déjà vu, Σίσυφος, 数据处理 и текст 😀👩‍👩‍👧 é"),
    (8, "don't we'll I'M 12345 678 -- !!"),
    (8, "don't we'll I'M 12345 678 -- !!"),
    (None, "no id"),
    (9, "x" * 3000),
    (10, "the word and the word " * 300),
    (11, "\x00\x01 control \x7f bytes"),
]


@pytest.fixture(scope="module")
def plain():
    """Alignment of whole texts by the two libraries, without cuts."""
    a, b = Tokenizer.from_file(PAIR.a), sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    a.encode_special_tokens = True
    bytes_a, bytes_b = alignment.byte_level_bytes(PAIR.a), alignment.piece_bytes(PAIR.b)

    def one(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if any(v.joined(np.array(i)).tobytes() != whole for v, i in zip((bytes_a, bytes_b), ids)):
            return None
        ends = [np.cumsum(v.sizes(np.array(i))).tolist() for v, i in zip((bytes_a, bytes_b), ids)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [
            (ids[0][i], ids[1][j])
            for i in range(len(ids[0]))
            for j in range(np.searchsorted(ends[1], starts[0][i], "right"), np.searchsorted(starts[1], ends[0][i], "left"))
        ]
        place = [{end: k + 1 for k, end in enumerate(e)} for e in ends]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [p[cut] for p in place]
            groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
            at = to
        return len(ids[0]), len(ids[1]), groups, links

    def all_of(rows):
        done = [(i, one(t)) for i, t in rows]
        counts = Counter(link for _, d in done if d for link in d[3])
        highest = {}
        for (_, y), n in counts.items():
            highest[y] = max(highest.get(y, 0), n)
        out = []
        for i, d in done:
            if d is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(counts[x] == highest[x[1]] for x in d[3])
            text = ";".join(d[2])
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((i, d[0], d[1], len(d[2]), len(d[3]), best, sum(counts[x] for x in d[3]), digest))
        return sorted(out, key=repr)

    return all_of


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_hard_texts(spark, docs, plain):
    out = alignment.align_texts(docs(HARD), PAIR)
    assert found(out) == plain(HARD)


def test_real_texts_in_small_chunks(spark, docs, plain, real, monkeypatch):
    """More chunks than documents: counts are still those of the corpus."""
    monkeypatch.setattr(alignment, "CHUNK", 40_000)
    out = alignment.align_texts(docs(real).repartition(3), PAIR)
    assert found(out) == plain(real)


def test_groups_as_text(spark, docs):
    row = alignment.align_texts(docs([(1, "hello")]), PAIR, keep_groups=True).first()
    assert re.fullmatch(r"(\d+,)*\d+\|(\d+,)*\d+(;(\d+,)*\d+\|(\d+,)*\d+)*", row.groups)
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


def test_no_documents(spark, docs):
    assert alignment.align_texts(docs([]), PAIR).count() == 0


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PAIR.a)
    a.encode_special_tokens = True
    return alignment.AlignedPieces(PAIR), a, sentencepiece.SentencePieceProcessor(model_file=PAIR.b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .'\n\t1é数▁  x"), max_size=40), min_size=1, max_size=6))
def test_cut_pieces_give_the_ids_of_whole_texts(libraries, texts):
    pieces, a, b = libraries
    for text in texts:
        codes = np.frombuffer((" " + text).encode(), np.uint8)
        start, end, _ = alignment._cut(codes, np.array([0, len(codes)]))
        cut = [codes[x:y].tobytes().decode() for x, y in zip(start, end)]
        assert pieces._encode_a(cut)[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert pieces._encode_b([c[1:] for c in cut])[0].tolist() == b.encode(text)


def test_merge_of_hand_written_ends():
    links = alignment.merge(np.array([2, 5, 1, 3]), np.array([2, 0, 2]), np.array([1, 2, 5, 3]), np.array([3, 0, 1]))
    assert links.string.tolist() == [0, 0, 0, 2, 2]
    assert list(zip(links.a.tolist(), links.b.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 3), (3, 3)]
    assert links.cut.tolist() == [False, True, True, False, True]
