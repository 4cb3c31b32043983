"""Trees over Gaussians and context-dependent states, grown from aggregated statistics.

Statistics are one row per Gaussian or state; the trees over them are grown here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .statistics import VARIANCE_FLOOR


def log_likelihood(gamma: float, sum1: np.ndarray, sum2: np.ndarray) -> float:
    """Of data under the Gaussian that fits it best, from its moments."""
    if gamma <= 0:
        return 0.0
    variance = np.maximum(sum2 / gamma - (sum1 / gamma) ** 2, VARIANCE_FLOOR)
    return float(-0.5 * gamma * (np.log(2 * np.pi * variance) + 1).sum())


@dataclass
class State:
    """A state in context: left-centre+right, with moments."""

    left: str
    centre: str
    right: str
    gamma: float
    sum1: np.ndarray
    sum2: np.ndarray


@dataclass
class Leaf:
    states: list[State]
    rules: list[tuple[str, frozenset, bool]] = field(default_factory=list)

    def total(self) -> tuple[float, np.ndarray, np.ndarray]:
        return sum(s.gamma for s in self.states), sum(s.sum1 for s in self.states), sum(s.sum2 for s in self.states)

    def value(self) -> float:
        return log_likelihood(*self.total())


def tie_states(states: list[State], questions: list[frozenset], count: float, gain: float, loss: float) -> list[Leaf]:
    """Leaves of decision trees, one tree per centre: split by the question on the left or right unit that gains most
    likelihood, while it gains `gain` and leaves `count` on both sides; then merge leaves of one centre that lose less than `loss`."""
    done: list[Leaf] = []
    for centre in sorted({s.centre for s in states}):
        todo, leaves = [Leaf([s for s in states if s.centre == centre])], []
        while todo:
            leaf = todo.pop()
            best = None
            for side in ("left", "right"):
                for q in questions:
                    yes = [s for s in leaf.states if getattr(s, side) in q]
                    no = [s for s in leaf.states if getattr(s, side) not in q]
                    if sum(s.gamma for s in yes) < count or sum(s.gamma for s in no) < count:
                        continue
                    a, b = Leaf(yes, [*leaf.rules, (side, q, True)]), Leaf(no, [*leaf.rules, (side, q, False)])
                    g = a.value() + b.value() - leaf.value()
                    if g >= gain and (best is None or g > best[0]):
                        best = (g, a, b)
            if best is None:
                leaves.append(leaf)
            else:
                todo += best[1:]
        while len(leaves) > 1:
            pairs = [(a.value() + b.value() - Leaf(a.states + b.states).value(), i, j) for i, a in enumerate(leaves) for j, b in enumerate(leaves) if i < j]
            least, i, j = min(pairs)
            if least >= loss:
                break
            merged = Leaf(leaves[i].states + leaves[j].states)
            leaves = [x for k, x in enumerate(leaves) if k not in (i, j)] + [merged]
        done += leaves
    return done


def _halves(means: np.ndarray, gammas: np.ndarray, at: np.ndarray, rounds: int) -> np.ndarray:
    """0 or 1 for each Gaussian of a node: the side that k-means gives it, from two centres beside the node's own."""
    centre = gammas[at] @ means[at] / gammas[at].sum()
    deviation = np.sqrt(gammas[at] @ (means[at] - centre) ** 2 / gammas[at].sum())
    centres = np.stack([centre + 0.2 * deviation, centre - 0.2 * deviation])
    for _ in range(rounds):
        side = ((means[at][:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if not 0 < side.sum() < len(at):
            side = np.arange(len(at)) % 2
        centres = np.stack([gammas[at][side == k] @ means[at][side == k] / gammas[at][side == k].sum() for k in (0, 1)])
    return side


def class_tree(means: np.ndarray, gammas: np.ndarray, leaves: int, rounds: int = 20) -> tuple[np.ndarray, list[int]]:
    """The leaf of each Gaussian as the number of its node, and the parent of each node (-1 of the root, node 0).

    The leaf with the greatest weighted spread is split in two, as k-means does, until there are enough.
    """

    def spread(at: np.ndarray) -> float:
        w, m = gammas[at], means[at]
        centre = w @ m / max(w.sum(), 1e-300)
        return float(w @ ((m - centre) ** 2).sum(1)) if len(at) > 1 else -1.0

    node, parents, open_ = np.zeros(len(means), int), [-1], [0]
    while len(open_) < leaves:
        scores = [spread(np.flatnonzero(node == k)) for k in open_]
        best = int(np.argmax(scores))
        if scores[best] <= 0:
            break
        at = np.flatnonzero(node == open_[best])
        side = _halves(means, gammas, at, rounds)
        parent = open_[best]
        node[at] = len(parents) + side
        # the first half keeps its parent's place among the leaves
        open_[best] = len(parents)
        open_.append(len(parents) + 1)
        parents += [parent, parent]
    return node, parents


def regression_tree(means: np.ndarray, gammas: np.ndarray, leaves: int, rounds: int = 20) -> np.ndarray:
    """The leaf of each Gaussian in `class_tree`, numbered from 0: of two halves the first keeps its parent's number."""
    node, parents = class_tree(means, gammas, leaves, rounds)
    number = {0: 0}
    for k in range(1, len(parents), 2):
        number[k], number[k + 1] = number[parents[k]], (k + 1) // 2
    return np.array([number[k] for k in node.tolist()], int)


def questions_of(units: list[str], key: Callable[[str], str] | None = None) -> list[frozenset]:
    """Each unit alone, and the groups that `key` forms."""
    out = [frozenset([u]) for u in sorted(units)]
    if key:
        groups: dict[str, set] = {}
        for u in units:
            groups.setdefault(key(u), set()).add(u)
        out += [frozenset(g) for _, g in sorted(groups.items()) if 1 < len(g) < len(units)]
    return out
