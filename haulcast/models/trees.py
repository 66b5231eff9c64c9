"""Regression trees of one unit, all trees of an ensemble growing level by level.

A unit is one series: the days of one entity and truck, so its arrays are bounded
by the days of the history. A level handles the nodes of all trees together:
elements (a row in a tree, with a weight) lie sorted by node, and sums inside nodes are
differences of running sums.

Cuts are exact: every middle between two neighbouring values of a node, the best
by squared error; the smaller feature, then the smaller cut wins a tie. With a
``draw`` each feature of a node offers one cut, drawn between its smallest and
largest value. A node whose targets differ and that has a cut is always split, as
far as ``depth``.

What is drawn comes from hashes of seed, unit, tree and place alone, so a fit is
the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Deepest level: nodes are numbered 1, then 2n and 2n + 1, in a long.
DEEPEST = 60

#: Gives the cuts of (trees, nodes, feature, lowest value, highest value), one per node.
Draw = Callable[[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def uniform(*seeds: int | np.ndarray) -> np.ndarray:
    """Numbers of [0, 1) drawn from whole numbers: a 64-bit mix of one after the other."""
    out = np.zeros(1, np.uint64)
    for seed in seeds:
        out = out ^ (np.atleast_1d(np.asarray(seed)).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        out = out ^ (out >> np.uint64(31))
    return (out >> np.uint64(11)) / float(1 << 53)


@dataclass
class Nodes:
    """Nodes of trees: ``feature`` is -1 in leaves."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def joined(parts: list[Nodes]) -> Nodes:
        return Nodes(*[np.concatenate([getattr(p, c) for p in parts]) for c in Nodes.__annotations__])


def grow(features: np.ndarray, y: np.ndarray, tree: np.ndarray, row: np.ndarray, weight: np.ndarray, depth: int, draw: Draw | None = None) -> tuple[Nodes, np.ndarray]:
    """Trees over the elements (tree, row, weight), and the value of the leaf that each element reaches.

    ``features`` has a line per row. Weights are above 0.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must be between 0 and {DEEPEST}")
    ranks = np.stack([np.unique(f, return_inverse=True)[1] for f in features.T])
    leaf = np.zeros(len(row))
    at = np.argsort(tree, kind="stable")  # elements that are still on their way, sorted by node
    node = np.ones(len(row), np.int64)
    levels: list[Nodes] = []
    for level in range(depth + 1):
        if not len(at):
            break
        here = _Level(features, ranks, y[row[at]], tree[at], node[at], row[at], weight[at])
        feature, cut = here.split(draw) if level < depth else here.leaves()
        value = here.sums / here.weights
        levels.append(Nodes(here.tree[here.start], here.node[here.start], feature, cut, value))
        goes_on = feature[here.group] >= 0
        leaf[at[~goes_on]] = value[here.group[~goes_on]]
        group = here.group[goes_on]
        at = at[goes_on]
        right = features[row[at], feature[group]] > cut[group]
        node[at] = 2 * node[at] + right
        # Left children come before right ones, inside the order of their parents.
        at = at[np.argsort(2 * group + right, kind="stable")]
    return Nodes.joined(levels), leaf


class _Level:
    """The elements of one level, sorted by node."""

    def __init__(self, features, ranks, y, tree, node, row, weight) -> None:
        self.features, self.ranks = features, ranks
        self.y, self.tree, self.node, self.row, self.weight = y, tree, node, row, weight
        fresh = np.ones(len(tree), bool)
        fresh[1:] = (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])
        self.start = np.flatnonzero(fresh)
        self.group = np.cumsum(fresh) - 1
        self.weights = np.add.reduceat(weight, self.start)
        self.sums = np.add.reduceat(weight * y, self.start)
        self.mixed = np.minimum.reduceat(y, self.start) < np.maximum.reduceat(y, self.start)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(self.start), -1), np.full(len(self.start), np.nan)

    def split(self, draw: Draw | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature and cut of every node that is split."""
        feature, cut = self.leaves()
        most = np.full(len(self.start), -np.inf)
        for f in range(self.features.shape[1]):
            gains, cuts = self._exact(f) if draw is None else self._drawn(f, draw)
            better = self.mixed & (gains > most)
            most[better], feature[better], cut[better] = gains[better], f, cuts[better]
        return feature, cut

    def _gain(self, weights: np.ndarray, sums: np.ndarray, group: np.ndarray | slice) -> np.ndarray:
        """What a cut takes off the squared error, up to a constant of the node."""
        right_weights, right_sums = self.weights[group] - weights, self.sums[group] - sums
        return sums * sums / weights + right_sums * right_sums / right_weights

    def _exact(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The best cut of each node, -inf where all values are equal."""
        ranks = self.ranks[f][self.row]
        order = np.argsort(self.group * (int(ranks.max()) + 1) + ranks, kind="stable")
        ranks, values, group = ranks[order], self.features[self.row[order], f], self.group[order]
        weights, sums = np.cumsum(self.weight[order]), np.cumsum((self.weight * self.y)[order])
        gains, cuts = np.full(len(self.start), -np.inf), np.full(len(self.start), np.nan)
        ends = np.flatnonzero((group[1:] == group[:-1]) & (ranks[1:] != ranks[:-1]))
        if not len(ends):
            return gains, cuts
        g = group[ends]
        before = np.maximum(self.start - 1, 0)
        first_weight, first_sum = np.where(self.start > 0, weights[before], 0.0), np.where(self.start > 0, sums[before], 0.0)
        gain = self._gain(weights[ends] - first_weight[g], sums[ends] - first_sum[g], g)
        present, first = np.unique(g, return_index=True)
        gains[present] = np.maximum.reduceat(gain, first)
        best = np.flatnonzero(gain == gains[g])
        winners, place = np.unique(g[best], return_index=True)
        chosen = ends[best[place]]
        cuts[winners] = _between(values[chosen], values[chosen + 1])
        return gains, cuts

    def _drawn(self, f: int, draw: Draw) -> tuple[np.ndarray, np.ndarray]:
        values = self.features[self.row, f]
        low, high = np.minimum.reduceat(values, self.start), np.maximum.reduceat(values, self.start)
        cuts = draw(self.tree[self.start], self.node[self.start], f, low, high)
        left = self.weight * (values <= cuts[self.group])
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = self._gain(np.add.reduceat(left, self.start), np.add.reduceat(left * self.y, self.start), slice(None))
        return np.where(low < high, gains, -np.inf), cuts


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The middle of two neighbouring values, or the lower one where rounding gives the higher."""
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def follow(nodes: Nodes, features: np.ndarray) -> np.ndarray:
    """Value of the leaf that each line of ``features`` reaches in one tree."""
    place = {n: i for i, n in enumerate(nodes.node.tolist())}
    children = np.array([[place.get(2 * n, i), place.get(2 * n + 1, i)] for i, n in enumerate(nodes.node.tolist())])
    at = np.full(len(features), place[1])
    while (nodes.feature[at] >= 0).any():
        right = features[np.arange(len(at)), nodes.feature[at]] > nodes.cut[at]
        at = children[at, right.astype(int)]
    return nodes.value[at]
