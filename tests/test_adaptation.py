"""Transforms of classes of Gaussians and warps under a model, speaker by speaker by brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cadenza.operators import adaptation, trees
from cadenza.operators.statistics import Mixture
from cadenza.operators.training import States


def test_leaves_take_the_nearest_ancestor_with_enough(spark):
    rng = np.random.default_rng(2)
    means = np.concatenate([rng.normal(size=(6, 2)) + c for c in ([0, 0], [12, 0], [0, 14], [12, 14])])
    mixture = Mixture(list(range(24)), np.full(24, 1 / 24), means, np.exp(0.2 * rng.normal(size=(24, 2))))
    leaf_of, parents = trees.class_tree(means, mixture.weights, 5)
    assert len(set(leaf_of.tolist())) == 5 and parents[0] == -1 and len(parents) == 9
    rows = []
    for speaker, n in ((0, 2000), (1, 150), (2, 40), (3, 2), (4, 60)):
        at = rng.integers(0, 24 if speaker != 1 else 6, n)
        x = means[at] * 1.1 + [0.5, -0.3] + rng.normal(size=(n, 2)) * np.sqrt(mixture.variances[at])
        rows += [(speaker, v.tolist()) for v in x]
    rows += [(0, None), (0, [1.0, None]), (None, [1.0, 1.0])]
    stats = adaptation.occupancies(spark.createDataFrame(rows, "s int, x array<double>").repartition(3), "s", "x", mixture)
    found = {(r.s, r.leaf): r for r in adaptation.class_transforms(stats, "s", leaf_of, parents, mixture, 30.0).collect()}
    assert len(found) == 5 * 5
    used = set()
    for speaker in (0, 1, 2, 3, 4):
        x = np.array([v for s, v in rows if s == speaker and v is not None and None not in v])
        p, _ = mixture.posteriors(x)
        gamma, first = p.sum(0), p.T @ x
        under = {k: [g for g in range(24) if k in (lambda n: [n, *ancestors(n, parents)])(leaf_of[g])] for k in range(len(parents))}
        for leaf in sorted(set(leaf_of.tolist())):
            way = [leaf, *ancestors(leaf, parents)]
            node = next((k for k in way if gamma[under[k]].sum() >= 30.0), None)
            r = found[speaker, leaf]
            assert r.node == node
            used.add((speaker, node, leaf))
            if node is None:
                assert r.transform is None
                continue
            assert r.gamma == pytest.approx(gamma[under[node]].sum())
            w = np.array(r.transform).reshape(2, 3)
            at = under[node]

            def likelihood(w):
                y = w[:, 0] + mixture.means[at] @ w[:, 1:].T
                return -0.5 * ((gamma[at][:, None] * y**2 - 2 * y * first[at]) / mixture.variances[at]).sum()  # noqa: B023

            best = likelihood(w)
            for _ in range(20):
                assert likelihood(w + 0.01 * rng.normal(size=w.shape)) <= best + 1e-6
    nodes = {node for _, node, _ in used}
    assert None in nodes and 0 in nodes and len(nodes) > 4
    # many Gaussians that were all moved alike: the transform is what moved them
    np.testing.assert_allclose(np.array(found[0, leaf_of[0]].transform).reshape(2, 3), [[0.5, 1.1, 0.0], [-0.3, 0.0, 1.1]], atol=0.25)


def ancestors(node: int, parents: list[int]) -> list[int]:
    out = []
    while parents[node] >= 0:
        node = parents[node]
        out.append(node)
    return out


def test_warps_are_scored_by_the_mixtures_of_aligned_states(spark):
    rng = np.random.default_rng(3)
    model = States(np.array([[0.3, 0.7], [0.5, 0.5], [1.0, 0.0]]), rng.normal(size=(3, 2, 4)) * 2, np.exp(rng.normal(size=(3, 2, 4)) * 0.3), np.full(3, 0.5))
    matrices = {w: np.eye(4) * w + 0.1 * np.eye(4, k=1) for w in (0.8, 0.9, 1.0, 1.1)}
    frames, true = [], {}
    for speaker, warp in ((0, 0.8), (1, 1.1), (2, 0.9)):
        for _ in range(120):
            s = int(rng.integers(3))
            k = rng.choice(2, p=model.weights[s])
            y = model.means[s, k] + rng.normal(size=4) * np.sqrt(model.variances[s, k])
            frames.append((speaker, s, np.linalg.solve(matrices[warp], y).tolist()))
        true[speaker] = warp
    table = spark.createDataFrame([*frames, (0, 1, None), (0, None, [1.0] * 4), (None, 1, [1.0] * 4)], "k int, s int, x array<double>").repartition(3)
    scores = adaptation.warp_scores(table, "k", "x", "s", matrices, model)
    got = {(r.k, r.warp): r.ll for r in scores.collect()}
    assert len(got) == 12
    for (speaker, warp), ll in got.items():
        total = 0.0
        for k, s, x in frames:
            if k == speaker:
                y = matrices[warp] @ np.array(x)
                total += np.log((model.weights[s] * np.exp(-0.5 * (np.log(2 * np.pi * model.variances[s]) + (y - model.means[s]) ** 2 / model.variances[s]).sum(1))).sum())
        assert ll == pytest.approx(total)
    best = {r.k: r.warp for r in adaptation.best_warps(scores, "k").collect()}
    assert best == {k: max(matrices, key=lambda w: (got[k, w], -w)) for k in true}
