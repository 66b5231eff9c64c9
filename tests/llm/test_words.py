from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from haulcast.llm import words as W
from hypothesis import given, settings
from hypothesis import strategies as st

TEXT = st.text(alphabet="aB \t\n\v1é✓#\x00", max_size=40)


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = W.words_of(pa.array(texts, pa.string()))
    expected = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))]
    got = [(int(d), found.codes[s:e].tobytes().decode()) for d, s, e in zip(found.doc, found.start, found.end)]
    assert got == expected
    hashes: dict[str, int] = {}
    for (_, word), h in zip(expected, found.hash.tolist()):
        assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_alphanumeric_words(texts):
    found = W.words_of(pa.array(texts, pa.string()), W.NOT_ALNUM)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    assert len(found.hash) == sum(len(re.findall(pattern, lower(t))) for t in texts)


def test_pieces_do_not_change_hashes(monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000)) + " " + "x" * 500
    whole = W.words_of(pa.array([text])).hash
    monkeypatch.setattr(W, "PIECE", 64)
    assert (W.words_of(pa.array([text])).hash == whole).all()


def test_grams_stay_in_their_text():
    found = W.words_of(pa.array(["a b c", "", None, "a b", "c"]))
    hashes, at = W.grams(found, 2)
    assert at.tolist() == [0, 1, 3]
    assert hashes[0] == hashes[2] != hashes[1]
    spans = W.span_hash(found.hash, np.array([0, 3]), np.array([2, 5]))
    assert spans[0] == spans[1]


def test_steps_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 100, "c"]})
    parts = list(W.steps(iter([batch]), "text", 20))
    assert sum(p.num_rows for p in parts) == 5
    assert pa.Table.from_batches(parts)["text"].to_pylist() == batch["text"].to_pylist()


def test_small_batches_are_gathered_up_to_the_limit():
    batches = [pa.RecordBatch.from_pydict({"n": [i], "text": ["x" * 10]}) for i in range(10)]
    large = pa.RecordBatch.from_pydict({"n": [10, 11, 12], "text": ["y" * 25, None, "z" * 31]})
    found = list(W.gathered(iter([*batches, large]), "text", 30))
    assert [b.column("n").to_pylist() for b in found] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9], [10, 11], [12]]


def test_window_sums_are_span_sums():
    draw = np.random.default_rng(4)
    for _ in range(50):
        ends = np.append(0, np.cumsum(draw.integers(1, 20, draw.integers(1, 9))))
        values = draw.integers(0, 1 << 60, ends[-1], dtype=np.uint64)
        spans = [(a, min(a + 8, high)) for low, high in zip(ends, ends[1:]) for a in range(low, max(high - 7, low + 1))]
        assert (W.window_sums(values, ends, 8) == W.span_sums(values, *np.array(spans).T)).all()
