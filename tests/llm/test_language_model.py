from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from haulcast.llm import language_model as LM
from haulcast.llm import mixer
from haulcast.llm.decontaminate import summed


def base(rows):
    """(held out, tokens, known, training tokens, base score) of each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for ws, h in zip(words, held)
    ]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def scores(df):
    return {r.doc_id: r for r in LM.score_texts(df).collect()}


def check(rows, out):
    for (i, _), (held, tokens, known, n, score) in zip(rows, base(rows)):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(score, rel=1e-9)


def test_base_scores_of_real_texts_and_model_learns(docs, real):
    out = scores(docs(real))
    check(real, out)
    held = [(i, t) for i, t in real if out[i].held_out]
    bits = -sum(out[i].score for i, _ in held) / math.log10(2)
    size = sum(len(t.encode()) + 1 for _, t in held)
    counts = Counter(b for i, t in real if not out[i].held_out for b in lower(t).encode())
    total = sum(counts.values())
    single = -sum(math.log2(counts[b] / total) for _, t in held for b in lower(t).encode())
    assert bits / size < 0.8 * single / size


@pytest.mark.parametrize("frequent", [1e9, 1e-9])
def test_frequent_words_and_buckets_agree(docs, real, monkeypatch, frequent):
    rows = real[:60]
    monkeypatch.setattr(LM, "FREQUENT", frequent)
    out = scores(docs(rows))
    check(rows, out)
    monkeypatch.setattr(LM, "LOAD", 1)
    again = scores(docs(rows))
    assert all(again[i].score == pytest.approx(out[i].score, rel=1e-9) for i, _ in rows)


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "Word"), (5, "word"), (6, "y" * 20000), (8, "é\x00ÿ"), (None, "z")]
    out = scores(docs(rows))
    check(rows, out)
    assert out[1].score == out[2].score < 0 and out[4].score == out[5].score
    twice = LM.score_texts(docs([(1, "a b"), (1, "a b")])).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].train_tokens == 6
    assert LM.score_texts(docs([])).collect() == []


def test_probabilities_of_all_next_bytes_sum_to_one():
    code = mixer.Code.of(np.arange(256))
    counts, online = mixer.Counts(), mixer.Mixer()
    units = np.frombuffer(b"the \xffcat sat\n", np.uint8)
    offsets, before = np.array([0, 5, 9, 13]), np.array([0, 3, 9])
    bits = mixer.Bits.of(code, units, offsets, before)
    online.learn(bits, counts.guess(bits), np.ones(len(bits.node)))
    counts.add(bits, np.ones(len(bits.node)))
    model = mixer.Model(code, counts.guesses(), online.weights, (online.ones / online.seen).astype(np.float32))
    prefix = b"th"
    texts = np.frombuffer(b"".join(prefix + bytes([b]) for b in range(256)), np.uint8)
    whole = model.log10(texts, np.arange(0, 3 * 256 + 1, 3), np.zeros(256, np.int64))
    head = model.log10(np.frombuffer(prefix, np.uint8), np.array([0, 2]), np.zeros(1, np.int64))
    assert (10 ** (whole - head)).sum() == pytest.approx(1, abs=1e-5)


def test_sums_of_large_counts_are_exact(spark):
    large = [2.0**24 + 1, 2.0**40 + 3, 1.0]
    rows = spark.range(4).repartition(2)
    assert summed(rows, lambda batches: np.array(large), 3).tolist() == [2 * x for x in large]


def test_a_slot_counts_past_the_steps_of_a_float():
    code = mixer.Code.of(np.arange(256))
    counts = mixer.Counts()
    bits = mixer.Bits.of(code, np.frombuffer(b"a ", np.uint8), np.array([0, 2]), np.array([0]))
    for weight in (1 << 24, 1, 1):
        counts.add(bits, np.full(len(bits.node), weight))
    assert all(t.max() % 2**24 == 2 for t in counts.tables[:2])


def test_the_last_two_bytes_are_a_context_and_odds_are_not_rounded():
    units, offsets = np.frombuffer(b"wxabc vyabd vzcbd ", np.uint8), np.array([0, 6, 12, 18])
    contexts = mixer._contexts(units, offsets, np.array([0, 7, 63]))
    assert len(contexts) == mixer.PREDICTORS == 5 and LM.PREVIOUS == 64
    # Before the fifth byte of each unit: "ab", "ab" and "cb".
    assert any(c[4] == c[10] != c[16] for c in contexts)
    code, counts = mixer.Code.of(np.arange(256)), mixer.Counts()
    bits = mixer.Bits.of(code, units, offsets, np.array([0, 7, 63]))
    counts.add(bits, np.arange(len(bits.node)) + 1)
    exact = counts.guess(bits)
    for table, slot, wanted in zip(counts.guesses(), bits.slots, exact):
        assert table[slot] == pytest.approx(wanted, rel=1e-5)


def test_all_classes_of_previous_words_are_told_apart():
    texts = [f"{w} end" for w in range(2000)]
    units = LM.Units(pa.array(texts))
    assert set(units.previous.tolist()) == set(range(64))


def test_every_unit_teaches_the_mixer():
    units = LM.Units(pa.array([" ".join(f"word{i}" for i in range(60000)) + " the" * 500]))
    code, counts, online = mixer.Code.of(np.arange(256)), mixer.Counts(), mixer.Mixer()
    LM.teach(code, units, counts, online)
    assert len(units.codes) > 4 * mixer.BLOCK
    assert online.total == counts.tables[0].sum() == code.length[units.codes].sum()


def test_steps_of_a_node_lie_together_and_sum_as_on_the_paths():
    code = mixer.Code.of(np.arange(256) ** 2)
    units, offsets = np.frombuffer(b"the cat sat \xff", np.uint8), np.array([0, 4, 8, 12, 13])
    bits = mixer.Bits.of(code, units, offsets, np.array([0, 3, 9, 5]))
    assert (np.diff(bits.node) >= 0).all() and len(bits.node) == code.length[units].sum()
    paths = []
    for at, rank in enumerate(code.rank[units].tolist()):
        for node, (low, middle, high) in enumerate(code.spans.tolist()):
            if low <= rank < high:
                paths.append((node, int(rank >= middle), at))
    found = list(zip(bits.node.tolist(), bits.bit.tolist(), bits.of_bytes(np.arange(len(units))).tolist()))
    assert sorted(found) == sorted(paths)
    weight = np.arange(len(found)) + 1.0
    by_node, by_byte = np.zeros(mixer.NODES), np.zeros(len(units))
    for (node, _, at), w in zip(found, weight):
        by_node[node] += w
        by_byte[at] += w
    assert (bits.by_node(weight) == by_node).all() and (bits.by_byte(weight) == by_byte).all()
    assert bits.of_nodes(np.arange(mixer.NODES)).tolist() == bits.node.tolist()


def test_few_slots_are_worked_out_and_counted_as_a_whole():
    code = mixer.Code.of(np.arange(256) ** 2)
    codes = np.random.default_rng(6).integers(97, 123, 1 << 16).astype(np.uint8)
    bits = mixer.Bits.of(code, codes, np.arange(0, len(codes) + 1, 8), np.zeros(len(codes) // 8, np.int64))
    weight = np.arange(len(bits.node)) % 5.0 + 1
    assert any(len(bits.slots[k]) >= 1 << b for k, b in enumerate(mixer.TABLE_BITS))
    plain = [np.zeros(2 << b, np.int32) for b in mixer.TABLE_BITS]
    for table, slot in zip(plain, bits.slots):
        np.add.at(table, 2 * slot.astype(np.int64) + bits.bit, weight.astype(np.int32))
    counts = mixer.Counts()
    counts.add(bits, weight)
    assert all((a == b).all() for a, b in zip(counts.tables, plain))
    for table, slot, guess in zip(counts.guesses(), bits.slots, counts.guess(bits)):
        assert np.abs(table[slot] - guess).max() < 1e-5

