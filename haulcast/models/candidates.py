"""The candidate regressors: each turns the rows of one unit into weighted trees.

``share`` is the weight of a tree in the forecast, which is the sum of the trees'
values times their shares, or their median weighted by the shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from haulcast.models import trees as growth
from haulcast.models.trees import Nodes, uniform


@dataclass(frozen=True)
class Settings:
    """Size of the ensembles. The defaults follow common library defaults; forests grow to depth 60 at most."""

    trees: int = 100
    depth: int = growth.DEEPEST
    boost_rounds: int = 50
    gbt_rounds: int = 100
    boost_depth: int = 3
    gbt_rate: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Unit:
    """Training days of one entity and truck, in the order of the days; ``seed`` comes from their names."""

    features: np.ndarray
    y: np.ndarray
    seed: int


@dataclass
class Ensemble:
    nodes: Nodes
    share: np.ndarray  # of each node's tree


#: Elements that one call grows side by side, which bounds the memory of a task.
ELEMENTS = 1 << 20


def _blocks(n_trees: int, n_rows: int) -> list[range]:
    size = max(1, ELEMENTS // n_rows)
    return [range(i, min(i + size, n_trees)) for i in range(0, n_trees, size)]


def bootstrap(seed: int, unit: Unit, tree: int) -> np.ndarray:
    """How often each row is drawn: as many draws as rows, with replacement."""
    n = len(unit.y)
    return np.bincount((uniform(seed, unit.seed, tree, np.arange(n)) * n).astype(np.int64), minlength=n)


def resample(seed: int, unit: Unit, tree: int, weights: np.ndarray) -> np.ndarray:
    """The same with draws by weight: row i holds the part of [0, 1) between the summed weights before it and with it."""
    ends = np.cumsum(weights)
    drawn = np.searchsorted(ends / ends[-1], uniform(seed, unit.seed, tree, np.arange(len(ends))), "right")
    return np.bincount(np.minimum(drawn, len(ends) - 1), minlength=len(ends))


def _forest(unit: Unit, s: Settings, seed_shift: int = 0) -> Ensemble:
    """Bootstrapped trees, all features at every split."""
    parts = []
    for block in _blocks(s.trees, len(unit.y)):
        counts = np.stack([bootstrap(s.seed + seed_shift, unit, t) for t in block])
        tree, row = np.nonzero(counts)
        weight = counts[tree, row].astype(float)
        parts.append(growth.grow(unit.features, unit.y, tree + block.start, row, weight, s.depth)[0])
    return _equal_shares(parts, s)


def _second_forest(unit: Unit, s: Settings) -> Ensemble:
    return _forest(unit, s, seed_shift=1)


def random_cuts(seed: int, unit: Unit) -> growth.Draw:
    """One cut per node and feature, between the lowest and the highest value."""

    def draw(tree: np.ndarray, node: np.ndarray, feature: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        cut = low + uniform(seed, unit.seed, tree, node, feature) * (high - low)
        return np.where(cut < high, cut, low)

    return draw


def _extra_trees(unit: Unit, s: Settings) -> Ensemble:
    """Trees of all rows that split at the best of one random cut per feature."""
    n, parts, draw = len(unit.y), [], random_cuts(s.seed, unit)
    for block in _blocks(s.trees, n):
        tree, row = np.repeat(np.arange(block.start, block.stop), n), np.tile(np.arange(n), len(block))
        parts.append(growth.grow(unit.features, unit.y, tree, row, np.ones(len(row)), s.depth, draw)[0])
    return _equal_shares(parts, s)


def _equal_shares(parts: list[Nodes], s: Settings) -> Ensemble:
    nodes = Nodes.joined(parts)
    return Ensemble(nodes, np.full(len(nodes.tree), 1.0 / s.trees))


def _one_tree(unit: Unit, y: np.ndarray, number: int, counts: np.ndarray, depth: int) -> Nodes:
    row = np.flatnonzero(counts)
    return growth.grow(unit.features, y, np.full(len(row), number), row, counts[row].astype(float), depth)[0]


def _gradient_boosting(unit: Unit, s: Settings) -> Ensemble:
    """From the mean on, each tree fits what the ones before leave, and counts by the rate. The mean is tree 0, a single leaf."""
    everything = np.ones(len(unit.y), np.int64)
    parts = [_one_tree(unit, unit.y, 0, everything, 0)]
    so_far = np.full(len(unit.y), parts[0].value[0])
    for number in range(1, s.gbt_rounds + 1):
        parts.append(_one_tree(unit, unit.y - so_far, number, everything, s.boost_depth))
        so_far = so_far + s.gbt_rate * growth.follow(parts[-1], unit.features)
    nodes = Nodes.joined(parts)
    return Ensemble(nodes, np.where(nodes.tree == 0, 1.0, s.gbt_rate))


def _adaboost(unit: Unit, s: Settings) -> Ensemble:
    """AdaBoost.R2 (Drucker, 1997), linear loss: trees on weighted resamples, well-predicted rows lose weight.

    It ends with a tree that is perfect, or before one whose mean loss is half or more (a first such tree is kept).
    """
    weights, parts, shares = np.full(len(unit.y), 1.0 / len(unit.y)), [], []
    for number in range(s.boost_rounds):
        tree = _one_tree(unit, unit.y, number, resample(s.seed, unit, number, weights), s.boost_depth)
        error = np.abs(unit.y - growth.follow(tree, unit.features))
        worst = error.max()
        loss = float((weights * error).sum() / worst) if worst else 0.0
        if loss >= 0.5 and parts:
            break
        parts.append(tree)
        beta = loss / (1.0 - loss) if loss < 0.5 else 1.0
        shares.append(math.log(1.0 / beta) if 0.0 < loss < 0.5 else 1.0)
        if not 0.0 < loss < 0.5:
            break
        weights = weights * beta ** (1.0 - error / worst)
        weights = weights / weights.sum()
    return Ensemble(Nodes.joined(parts), np.repeat(shares, [len(p.tree) for p in parts]))


#: In the order in which ties between models are settled.
CANDIDATES: dict[str, Callable[[Unit, Settings], Ensemble]] = {
    "random_forest": _forest,
    "adaboost": _adaboost,
    "extra_trees": _extra_trees,
    "gradient_boosting": _gradient_boosting,
    "random_forest_2": _second_forest,
}

#: Candidates whose forecast is the weighted median of their trees; the others add their trees up.
BY_MEDIAN = ("adaboost",)
