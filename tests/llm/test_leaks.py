from __future__ import annotations

import random

import pytest
from haulcast.llm import decontaminate as D


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a"]
    rare = [f"w{draw.randrange(10**6)}" for _ in range(3000)]

    def text(n):
        return [draw.choice(common) if draw.random() < 0.5 else draw.choice(rare) for _ in range(n)]

    items = [(i, text(draw.randrange(15, 60))) for i in range(30)]
    rows, truth = [], {}
    for i in range(120):
        words = text(draw.randrange(0, 300))
        if i % 3 == 0:
            number, item = draw.choice(items)
            leak = list(item)
            if i % 2:  # a paraphrase: some words changed or added, the answer kept
                for k in draw.sample(range(len(leak) - D.ANSWER), len(leak) // 8):
                    leak[k] = draw.choice(rare)
            at = draw.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 4 == 0 else w for w in leak]
            truth[i] = number
        rows.append((i, " ".join(words)))
    return items, rows, truth


def test_copies_and_paraphrases(spark, docs, corpus):
    items, rows, truth = corpus
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    out = {r.doc_id: r for r in D.find_leaks(docs(rows), bench).collect()}
    assert {i: r.leaked_item for i, r in out.items() if r.contaminated} == truth
    for i, number in truth.items():
        words = dict(rows)[i].lower().split()
        assert out[i].leaked_share == pytest.approx(subsequence(dict(items)[number], words) / len(dict(items)[number]), abs=0.1)
    kept = D.drop_leaks(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - set(truth)


def test_half_an_item_without_its_answer_is_clean(spark, docs, corpus):
    items, rows, _ = corpus
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    halves = [(1000 + i, " ".join(w[: len(w) // 2])) for i, w in items]
    out = D.find_leaks(docs([*rows, *halves]), bench).where("doc_id >= 1000 and contaminated")
    assert out.count() == 0


def test_blocks_of_items_change_nothing(spark, docs, corpus, monkeypatch):
    items, rows, truth = corpus
    monkeypatch.setattr(D, "BLOCK", 7)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    out = D.find_leaks(docs(rows), bench).where("contaminated").collect()
    assert {r.doc_id: r.leaked_item for r in out} == truth


@pytest.mark.parametrize("items", [[], [(None, "a b"), (1, None), (2, ""), (3, "a b c")]])
def test_edges(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "some text"), (None, "x " * 4000), (3, "some text")]
    out = D.find_leaks(docs(rows), bench).collect()
    assert len(out) == 5 and not any(r.contaminated for r in out)
    assert D.find_leaks(docs([]), bench).collect() == []


def test_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(100):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(1, 12))] for _ in range(2))
        assert D.common_subsequence(D._masks(a), len(a), b) == subsequence(a, b)


def test_a_long_unbroken_run_without_the_answer_is_a_leak(spark, docs, corpus):
    _, rows, truth = corpus
    draw = random.Random(4)
    item = [f"q{draw.randrange(10**6)}" for _ in range(60)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    clean = dict(rows)[1].split() if 1 not in truth else []
    cuts = {2000: item[:47], 2001: item[:33], 2002: item[10:45], 2003: item[:20], 2004: item[:30]}
    added = [(i, " ".join([*clean[:50], *cut, *clean[50:]])) for i, cut in cuts.items()]
    out = D.find_leaks(docs([*rows, *added]), bench).where("contaminated").collect()
    assert {r.doc_id: r.leaked_item for r in out} == {2000: 7, 2001: 7, 2002: 7}
