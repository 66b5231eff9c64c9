from __future__ import annotations

import random

import numpy as np
from haulcast.llm import substrings


def brute(rows, size):
    """id -> kept words; a window goes if its words start at a smaller (id, place)."""
    first: dict[tuple, tuple] = {}
    words = {i: (t or "").split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] != (i, k):
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def found(df, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, **more).collect()}


def test_against_all_windows(docs):
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(60):
        words = [f"u{draw.randrange(5)}" for _ in range(draw.randrange(0, 90))]
        at = draw.randrange(len(words) + 1)
        cut = draw.randrange(0, 30)
        rows.append((i * 37 % 101, " ".join(words[:at] + passage[cut : cut + 25 + draw.randrange(10)] + words[at:])))
    rows.append((500, "again and " * 300))
    assert found(docs(rows), size=20) == brute(rows, 20)
    assert found(docs(rows), size=8, buckets=3) == brute(rows, 8)


def test_frequent_minimisers_split_buckets_without_change(docs, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(200))) for i in range(1, 80)]
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    assert found(docs(rows)) == brute(rows, 20)
    monkeypatch.setattr(substrings, "FREQUENT", 1e9)
    assert found(docs(rows)) == brute(rows, 20)


def test_real_texts(docs, real):
    assert found(docs(real)) == brute(real, 20)


def test_edges(docs):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(3, text), (3, text), (9, text), (None, text), (4, None), (5, ""), (6, "\n \t")]
    out = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs(rows)).collect()]
    assert sorted(out, key=repr) == sorted(
        [(3, 25, 0), (3, 25, 0), (9, 25, 25), (None, 25, 25), (4, 0, 0), (5, 0, 0), (6, 0, 0)], key=repr
    )
    assert found(docs([])) == {}


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 50):
        assert substrings.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert len(substrings.sliding_min(x, 51)) == 0
