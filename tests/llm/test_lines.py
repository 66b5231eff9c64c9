from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from haulcast.llm import fuzzy_lines as L
from haulcast.llm.neardup import open_pairs


def brute(rows):
    """id -> (lines, removed numbers) by comparing all pairs of lines."""
    seen, n = {}, {}
    for i, text in rows:
        n[i] = 0
        for k, line in enumerate((text or "").lower().split("\n")):
            if words := line.split():
                seen.setdefault(" ".join(words), []).append((i, k))
                n[i] += 1
    lines = list(seen)
    sets = [{x[a : a + L.SHINGLE] for a in range(max(len(x) - L.SHINGLE + 1, 1))} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    groups: dict[int, list] = {}
    for a, line in enumerate(lines):
        groups.setdefault(find(a), []).extend(seen[line])
    gone: dict[int, list] = {i: [] for i in n}
    for places in groups.values():
        for i, k in set(places) - {min(places)}:
            gone[i].append(k)
    return {i: (n[i], sorted(gone[i])) for i in n}


def found(df):
    return {r.doc_id: (r.n_lines, r.removed) for r in L.judge_lines(df).collect()}


def test_edited_lines(docs):
    draw = random.Random(8)
    bases = ["".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(20, 150))) for _ in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(draw.randrange(0, 6)):
            line = list(draw.choice(bases))
            for _ in range(draw.randrange(0, 4)):
                line[draw.randrange(len(line))] = draw.choice("xyz")
            lines.append("".join(line).upper() if draw.random() < 0.2 else "".join(line) + draw.choice(["", "  ", "\r"]))
        rows.append((i * 31 % 89, "\n".join(lines)))
    assert found(docs(rows)) == brute(rows)


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "ab\nAB\nab c"), (5, "x" * 9000), (6, "x" * 9000 + "\nab")]
    assert found(docs(rows)) == {1: (0, []), 2: (0, []), 3: (0, []), 4: (3, [1]), 5: (1, []), 6: (2, [0, 1])}
    assert L.judge_lines(docs([])).collect() == []


def test_repeated_rows_and_rows_without_id(docs):
    rows = [(1, "one line\nnext"), (1, "one line\nnext"), (None, "one line\nown")]
    out = sorted((str(r.doc_id), r.removed) for r in L.judge_lines(docs(rows)).collect())
    assert out == [("1", []), ("1", []), ("None", [0])]


def test_texts_without_the_removed_lines(docs):
    rows = [(1, "keep this line\nand this"), (2, "first\nkeep this line\n\nlast"), (3, None)]
    out = L.remove_lines(docs(rows))
    assert out.columns == docs(rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "first\n\nlast", 3: None}


def test_first_shingles_are_few_and_similar_lines_share_one(spark):
    draw = random.Random(3)
    texts = {}
    for i in range(0, 60, 2):
        base = "".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(60, 200)))
        texts[i], texts[i + 1] = base + " as all lines end", base[:-3] + "xyz as all lines end"
    texts[60] = "short"
    lines = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    rows = L.first_shingles(lines, 80).collect()
    sets = {i: {x[a : a + L.SHINGLE] for a in range(max(len(x) - L.SHINGLE + 1, 1))} for i, x in texts.items()}
    mine = {i: {r.place: r.key for r in rows if r.id == i} for i in texts}
    for i, elements in sets.items():
        n = len(elements)
        assert {r.n for r in rows if r.id == i} == {n}
        assert sorted(mine[i]) == list(range(1, n + 2 + (-n * 80 // 100)))
    for i in sets:
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                assert set(mine[i].values()) & set(mine[j].values())
    # What all lines hold comes last, so that it makes no pairs.
    assert max(Counter(r.key for r in rows).values()) <= 4


class Plain:
    """Runs a function on batches without Spark."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_equal_lines_of_a_load_are_hashed_once(monkeypatch):
    hashed, minima = [], L.minima
    monkeypatch.setattr(L, "minima", lambda found, starts, hashes: hashed.append(len(starts) - 1) or minima(found, starts, hashes))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["one line here\nanother line", "ONE  line here"]})
    rows = Plain(batch, batch, batch)
    out = L.line_table(rows, L.HASHES, 4)
    assert hashed == [2]
    assert sum(b.num_rows - b.column("bucket").null_count for b in out) <= 4
    assert sum(b.column("bucket").null_count for b in out) == 6


def test_bits_rule_out_far_lines_and_no_similar_ones():
    draw = random.Random(8)
    pairs = []
    for _ in range(400):
        one = "".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(1, 900))).strip() or "a"
        two = list(one)
        for _ in range(draw.randrange(0, 1 + len(one) // 20)):
            two[draw.randrange(len(two))] = draw.choice("xyz")
        pairs.append((one, "".join(two)))
    sides = [pa.array(x) for x in zip(*pairs)]
    marks = [L._marked(np.frombuffer(b"".join(t.encode() for t in x), np.uint8), np.cumsum([0, *[len(t.encode()) for t in x]])) for x in zip(*pairs)]
    batch = pa.RecordBatch.from_arrays([*sides, *marks], names=["t_a", "t_b", "m_a", "m_b"])
    may = L.may_be_similar(batch, 80)
    far = []
    for (one, two), kept in zip(pairs, may):
        x, y = ({t[a : a + L.SHINGLE] for a in range(max(len(t) - L.SHINGLE + 1, 1))} for t in (one, two))
        alike = len(x & y) / len(x | y)
        assert kept or alike < 0.8
        assert L._overlap(*(L._sets(pa.array([t]))[0] for t in (one, two)), 80) == (alike >= 0.8)
        if alike < 0.6:
            far.append(kept)
    assert len(far) > 50 and np.mean(far) < 0.2


def test_nearly_similar_lines_make_few_pairs(spark):
    """A family of lines that are 0.5 to 0.75 alike, and a few that are similar to one of them."""
    draw = random.Random(4)
    base = "".join(draw.choice("abcdefgh é") for _ in range(400))
    texts = {}
    for i in range(60):
        line = list(base)
        for at in draw.sample(range(400), 6):
            line[at] = draw.choice("xyz")
        texts[i] = "".join(line)
        if i % 10 == 0:
            texts[100 + i] = texts[i][:390] + "0123456789"
    sets = {i: {x[a : a + L.SHINGLE] for a in range(len(x) - L.SHINGLE + 1)} for i, x in texts.items()}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    wanted = {pair for pair, x in alike.items() if x >= 0.8}
    near = [pair for pair, x in alike.items() if 0.5 <= x < 0.75]
    lines = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    members = lines.selectExpr("id", "id as root")
    got = {(r.a, r.b) for r in open_pairs(L.first_shingles(lines, 80), members, 80, L.PARITY).collect()}
    assert wanted <= got
    assert len(wanted) >= 6 and len(near) > 1000
    assert len(got - wanted) < len(near) / 10


def test_bits_after_a_place_are_those_of_the_shingles_after_it():
    found = np.random.default_rng(6).integers(0, 1 << 64, 50, dtype=np.uint64)
    line = np.repeat([0, 1, 2], [30, 1, 19])
    sent = np.arange(50) % 3 == 0
    got = L.parity_after(found, line, sent)
    for column, i in enumerate(np.flatnonzero(sent)):
        odd = Counter(int(x >> np.uint64(32)) % 256 for x, at in zip(found[i + 1 :], line[i + 1 :]) if at == line[i])
        bits = {64 * w + b for w in range(4) for b in range(64) if int(got[w, column]) >> b & 1}
        assert bits == {b for b, n in odd.items() if n % 2}
    assert L.parity_after(found[:0], line[:0], sent[:0]).shape == (4, 0)
