"""Trees, draws and boosting against versions written out plainly."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from haulcast.models import candidates, trees
from haulcast.models.candidates import CANDIDATES, Settings, Unit
from haulcast.models.trees import uniform


def unit(n=60, seed=1):
    rng = random.Random(seed)
    features = [[round(rng.random() * 20) / 2, 2020.0 + i % 3, 1.0 + i % 12, 1.0 + i % 7] for i in range(n)]
    return Unit(np.array(features), np.array([float(rng.randrange(6) + f[0] // 3) for f in features]), seed)


def plain_tree(rows, depth, cuts_of, node=1, level=0):
    """{node: (feature, cut, value)} by recursion over (features, y, weight) rows."""
    weight = sum(w for _, _, w in rows)
    value = sum(w * y for _, y, w in rows) / weight
    best = None
    if level < depth and len({y for _, y, _ in rows}) > 1:
        for f in range(len(rows[0][0])):
            for cut in cuts_of(rows, f, node):
                sides = [[r for r in rows if (r[0][f] > cut) == side] for side in (False, True)]
                gain = sum(sum(w * y for _, y, w in s) ** 2 / sum(w for _, _, w in s) for s in sides)
                if best is None or gain > best[0]:
                    best = (gain, f, cut, sides)
    if best is None:
        return {node: (-1, None, value)}
    _, f, cut, (low, high) = best
    out = {node: (f, cut, value)}
    out |= plain_tree(low, depth, cuts_of, 2 * node, level + 1)
    return out | plain_tree(high, depth, cuts_of, 2 * node + 1, level + 1)


def all_cuts(rows, f, node):
    values = sorted({x[f] for x, _, _ in rows})
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def walk(tree, x):
    node = 1
    while tree[node][0] >= 0:
        node = 2 * node + (x[tree[node][0]] > tree[node][1])
    return tree[node][2]


def as_dict(nodes, number):
    mine = nodes.tree == number
    columns = [c[mine].tolist() for c in (nodes.node, nodes.feature, nodes.cut, nodes.value)]
    return {n: (f, None if f < 0 else c, v) for n, f, c, v in zip(*columns)}


def same(a, b):
    assert a.keys() == b.keys()
    for n in a:
        assert a[n][:2] == b[n][:2]
        assert a[n][2] == pytest.approx(b[n][2], abs=1e-9)


@pytest.mark.parametrize("depth", [0, 1, 3, 60])
def test_exact_trees_equal_plain_recursion(depth):
    u = unit()
    counts = [np.bincount(np.random.default_rng(s).integers(0, 60, 60), minlength=60) for s in range(4)]
    tree, row = np.nonzero(np.stack(counts))
    weight = np.stack(counts)[tree, row].astype(float)
    nodes, leaf = trees.grow(u.features, u.y, tree, row, weight, depth)
    for t in range(4):
        rows = [(tuple(u.features[i]), u.y[i], float(c)) for i, c in enumerate(counts[t]) if c]
        want = plain_tree(rows, depth, all_cuts)
        same(as_dict(nodes, t), want)
        for i, value in zip(row[tree == t], leaf[tree == t]):
            assert value == pytest.approx(walk(want, u.features[i]), abs=1e-9)


def test_extra_trees_take_the_best_drawn_cut():
    u, s = unit(40), Settings(trees=5)
    nodes = CANDIDATES["extra_trees"](u, s).nodes
    for t in range(5):

        def drawn(rows, f, node, t=t):
            low, high = min(x[f] for x, _, _ in rows), max(x[f] for x, _, _ in rows)
            cut = low + uniform(s.seed, u.seed, t, node, f)[0] * (high - low)
            return [] if low == high else [min(cut, high) if cut < high else low]

        rows = [(tuple(x), y, 1.0) for x, y in zip(u.features, u.y)]
        same(as_dict(nodes, t), plain_tree(rows, s.depth, drawn))


def test_resample_is_the_inverse_of_the_summed_weights():
    u = unit(50)
    weights = np.array([0.0 if i % 9 == 0 else 1.0 + i % 5 for i in range(50)])
    total, counts = sum(weights), [0] * 50
    for j in range(50):
        place, i, seen = uniform(7, u.seed, 3, j)[0], 0, weights[0]
        while seen / total <= place:
            i += 1
            seen += weights[i]
        counts[i] += 1
    got = candidates.resample(7, u, 3, weights)
    assert got.tolist() == counts
    assert got.sum() == 50 and got[weights == 0].sum() == 0


def test_bootstrap_draws_as_many_as_there_are_rows():
    u = unit(200)
    draws = [candidates.bootstrap(1, u, t) for t in range(30)]
    assert {int(d.sum()) for d in draws} == {200}
    assert 0.60 < np.mean([(d > 0).mean() for d in draws]) < 0.66  # 1 - 1/e of the rows


def test_boosting_from_the_mean_equals_a_plain_loop_of_stumps():
    u, s = unit(), Settings(gbt_rounds=10, boost_depth=1)
    model = CANDIDATES["gradient_boosting"](u, s)
    so_far = [sum(u.y) / len(u.y)] * len(u.y)
    assert as_dict(model.nodes, 0) == {1: (-1, None, pytest.approx(so_far[0]))}
    for number in range(1, 11):
        rows = [(tuple(x), y - f, 1.0) for x, y, f in zip(u.features, u.y, so_far)]
        stump = plain_tree(rows, 1, all_cuts)
        same(as_dict(model.nodes, number), stump)
        so_far = [f + 0.1 * walk(stump, x) for f, x in zip(so_far, u.features)]
    assert set(model.share[model.nodes.tree > 0]) == {0.1} and set(model.share[model.nodes.tree == 0]) == {1.0}


def test_adaboost_equals_a_plain_loop():
    u, s = unit(), Settings(boost_rounds=6, boost_depth=2)
    model = CANDIDATES["adaboost"](u, s)
    weights = [1 / len(u.y)] * len(u.y)
    for number in range(6):
        counts = candidates.resample(s.seed, u, number, np.array(weights))
        rows = [(tuple(x), y, float(c)) for x, y, c in zip(u.features, u.y, counts) if c]
        tree = plain_tree(rows, 2, all_cuts)
        errors = [abs(y - walk(tree, x)) for x, y in zip(u.features, u.y)]
        loss = sum(w * e / max(errors) for w, e in zip(weights, errors))
        if loss >= 0.5:
            break
        same(as_dict(model.nodes, number), tree)
        beta = loss / (1 - loss)
        assert model.share[model.nodes.tree == number][0] == pytest.approx(math.log(1 / beta))
        weights = [w * beta ** (1 - e / max(errors)) for w, e in zip(weights, errors)]
        weights = [w / sum(weights) for w in weights]
    assert len(set(model.nodes.tree.tolist())) >= 2


@pytest.mark.parametrize("name", sorted(CANDIDATES))
def test_one_row_and_equal_targets_are_single_leaves(name):
    s = Settings(trees=3, boost_rounds=3, gbt_rounds=3)
    for u in (Unit(np.array([[1.0, 2.0]]), np.array([4.0]), 5), Unit(unit().features, np.full(60, 4.0), 5)):
        model = CANDIDATES[name](u, s)
        assert set(model.nodes.feature.tolist()) == {-1}
        assert model.nodes.value[0] == 4.0


def test_blocks_of_trees_do_not_matter(monkeypatch):
    u, s = unit(), Settings(trees=7)
    whole = {name: CANDIDATES[name](u, s).nodes for name in ("random_forest", "extra_trees")}
    monkeypatch.setattr(candidates, "ELEMENTS", 150)
    for name, nodes in whole.items():
        again = CANDIDATES[name](u, s).nodes
        for t in range(7):
            same(as_dict(nodes, t), as_dict(again, t))


def test_depth_is_bounded():
    with pytest.raises(ValueError, match="depth"):
        CANDIDATES["random_forest"](unit(), Settings(depth=61))
