from __future__ import annotations

import random

import pytest
from haulcast.llm import neardup
from haulcast.llm.components import components


def brute(rows, n, percent):
    """(id -> component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df, rows, **more):
    out = neardup.near_duplicates(df, **more).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_groups_of_edited_copies(spark, docs):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, number = [], 100
    for _ in range(4):
        base = [draw.choice(vocabulary) for _ in range(60)]
        for _ in range(40):
            text = list(base)
            for _ in range(draw.randint(0, 9)):
                text[draw.randrange(60)] = draw.choice(vocabulary) + draw.choice(["", "x", "y"])
            rows.append((number, " ".join(text)))
            number = number * 7 % 100003
    rows = list(dict(rows).items())
    assert result(docs(rows), rows, words=2) == brute(rows, 2, 80)


def test_small_table_of_real_texts(docs, real):
    assert result(docs(real), real, words=5) == brute(real, 5, 80)


def test_edges(docs):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (3, "One"), (9, "a b"), (2, "A\tB"), (4, "a b c d e"), (1, "x " * 5000)]
    found = result(docs(rows), rows, words=2)
    assert found[5] == (0, 5) and found[6] == (0, 6) and found[7] == (0, 7)
    assert found[8] == found[3] == (1, 3) and found[9] == found[2] == (1, 2)
    assert found[4] == (4, 4) and found[1] == (1, 1)


def test_repeated_ids_and_rows_without_id(docs):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(7, text), (7, text), (7, other), (9, text), (8, other), (None, text), (None, text)]
    out = neardup.near_duplicates(docs(rows), words=2).collect()
    assert len(out) == 7
    assert {r.component_id for r in out if r.doc_id is not None} == {7}
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert sum(r.kept for r in out if r.doc_id is not None) == 3


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).collect() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5)], [], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r.node: r.root for r in out}
    groups: dict[int, int] = {}
    for u, v in edges * 60:
        low = min(groups.get(u, u), groups.get(v, v))
        if u != v:
            groups[u] = groups[v] = low
    assert roots == groups
