"""Discriminative updates, trees and networks."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from cadenza.operators import discriminative as dis
from cadenza.operators import networks, statistics, trees


def test_smoothing_is_the_least_that_keeps_variances_positive():
    rng = np.random.default_rng(0)
    for _ in range(50):
        mean, variance = rng.normal(size=3), rng.uniform(0.5, 2, 3)
        num, den = (float(rng.uniform(1, 5)) for _ in "ab")
        x, y = rng.normal(size=(20, 3)), rng.normal(size=(20, 3)) * 2
        n = (num, num * x.mean(0), num * (x**2).mean(0))
        d = (den, den * y.mean(0), den * (y**2).mean(0))
        gamma, s1, s2 = (a - b for a, b in zip(n, d, strict=True))
        least = dis.least_smoothing(gamma, s1, s2, mean, variance)

        def variances(k, g=gamma, s1=s1, s2=s2, m=mean, v=variance):
            new = (s1 + k * m) / (g + k)
            return (s2 + k * (v + m**2)) / (g + k) - new**2

        assert (variances(least * 1.01 + 1e-6) > -1e-9).all()
        _, v, _ = dis.ebw_gaussian(n, d, mean, variance)
        assert (v > 0).all()


def test_without_denominator_the_update_is_smoothed_likelihood():
    x = np.random.default_rng(1).normal(2.0, 1.5, size=(5000, 2))
    n = (5000.0, x.sum(0), (x**2).sum(0))
    zero = (0.0, np.zeros(2), np.zeros(2))
    mean, variance, d = dis.ebw_gaussian(n, zero, np.zeros(2), np.ones(2))
    assert d < 1 and np.allclose(mean, x.mean(0), atol=1e-3) and np.allclose(variance, x.var(0), rtol=1e-2)
    w = dis.ebw_weights(np.array([3.0, 1.0]), np.zeros(2), np.array([0.5, 0.5]))
    np.testing.assert_allclose(w, [0.75, 0.25])


def test_weights_climb_the_auxiliary_function():
    num, den, old = np.array([5.0, 2.0, 3.0]), np.array([2.0, 2.0, 1.0]), np.array([0.2, 0.5, 0.3])
    value = lambda w: (num * np.log(w) - den * w / old).sum()
    w = dis.ebw_weights(num, den, old)
    assert w.sum() == pytest.approx(1) and value(w) >= value(old)
    rng = np.random.default_rng(0)
    assert all(value(w) >= value(v) - 1e-6 for v in rng.dirichlet(np.ones(3), 300))


def test_maximize_finds_the_top():
    a = np.diag([1.0, 10.0, 100.0])
    top = np.array([1.0, -2.0, 3.0])
    x = dis.maximize(lambda x: (-(x - top) @ a @ (x - top) / 2, -a @ (x - top)), np.zeros(3))
    np.testing.assert_allclose(x, top, atol=1e-4)


def test_sampled_distance_is_near_the_closed_form(spark):
    a = statistics.Mixture([0], np.ones(1), np.zeros((1, 2)), np.ones((1, 2)))
    b = statistics.Mixture([0], np.ones(1), np.array([[1.0, 0.0]]), np.full((1, 2), 2.0))
    r = dis.sampled_distances(spark, a, b, 20_000).first()
    assert r.kl == pytest.approx(statistics.gaussian_kld(a.means, a.variances, b.means, b.variances)[0], abs=0.03)
    assert r == dis.sampled_distances(spark, a, b, 20_000).first()


def test_tying_groups_like_contexts():
    rng = np.random.default_rng(2)
    states = []
    for left, right in itertools.product("aeks", "aeks"):
        x = rng.normal(3.0 if left in "ae" else -3.0, 1.0, size=(100, 2))
        states.append(trees.State(left, "t", right, 100.0, x.sum(0), (x**2).sum(0)))
    leaves = trees.tie_states(states, [frozenset("ae"), frozenset("ks"), *map(frozenset, "aeks")], 50, 50.0, 50.0)
    assert sorted(sorted({s.left for s in leaf.states}) for leaf in leaves) == [["a", "e"], ["k", "s"]]
    label = trees.regression_tree(np.array([[0.0], [0.2], [9.0], [9.1]]), np.ones(4), 2)
    assert label[0] == label[1] != label[2] == label[3]


def test_network_search_by_enumeration(spark):
    rng = np.random.default_rng(3)
    arcs = [(0, 1, "a", "x", -0.5), (0, 2, "b", "y", -0.2), (1, 1, "a", "", -0.1), (1, 3, "b", "", -0.3), (2, 3, "a", "", -0.4), (3, 3, "b", "", -0.2)]
    scores = rng.normal(size=(5, 2))
    best = max((sum(arcs[i][4] + scores[t, "ab".index(arcs[i][2])] for t, i in enumerate(p)), " ".join(arcs[i][3] for i in p if arcs[i][3])) for p in itertools.product(range(6), repeat=5) if arcs[p[0]][0] == 0 and arcs[p[-1]][1] == 3 and all(arcs[i][1] == arcs[j][0] for i, j in itertools.pairwise(p)))
    df = spark.createDataFrame([("u", t, s) for t, s in enumerate(scores.tolist())], "utt string, frame int, scores array<double>")
    for histories in (False, True):
        r = networks.network_search(df, arcs, 0, {3: 0.0}, ["a", "b"], histories=histories).first()
        assert (r.words, pytest.approx(r.score)) == (best[1], best[0])


def test_grammar_prefixes(spark):
    grammar = spark.createDataFrame([(0, 1, "a"), (1, 2, "!NULL"), (2, 0, "b"), (1, 3, "c")], "src int, dst int, word string")
    sentences = spark.createDataFrame([(0, ["a", "b", "a", "c", "x"]), (1, ["b"]), (2, []), (3, ["a", "b", "a", "b"])], "id int, words array<string>")
    assert {r.id: r.matched for r in networks.accepts_prefix(grammar, sentences, "id").collect()} == {0: 4, 1: 0, 2: 0, 3: 4}
