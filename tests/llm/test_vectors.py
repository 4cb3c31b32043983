"""Operators on vectors: near-duplicates and exact top-k."""

from __future__ import annotations

import numpy as np
import pytest

from cadenza.llm import kdtopk, vecgraph

SCHEMA = "vec_id long, embedding array<float>, label int, score long, item long, x double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3.0) for i, v in rows], SCHEMA)


def odd_rows(first: int):
    nan, inf = float("nan"), float("inf")
    return [(first, None), (first + 1, [0.0] * 16), (first + 2, [nan] + [1.0] * 15), (first + 3, [inf] + [1.0] * 15), (first + 4, [None] + [1.0] * 15), (first + 5, []), (first + 6, [0.5] * 4), (None, [1.0] * 16)]


def sample(n: int, copies: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    near = x[rng.integers(0, n // 10, copies)] + rng.normal(size=(copies, 16)) * 0.05
    tight = x[0] + rng.normal(size=(copies, 16)) * 0.03
    same = x[rng.integers(0, n, 20)]
    return np.concatenate([x, near, tight, same]).astype(np.float32)


def brute_links(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    return links


def components(links: np.ndarray) -> np.ndarray:
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None], len(links)).min(1))
        if np.array_equal(new, label):
            return label
        label = new


@pytest.mark.parametrize("part", [1500, 60])
def test_near_vectors_against_brute_force(spark, monkeypatch, part):
    """One part, and many clusters cut into several parts."""
    monkeypatch.setattr(vecgraph, "PART", part)
    x = sample(800, 150)
    frame = table(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *odd_rows(5000)])
    result = vecgraph.near_vectors(frame).cache()
    out = {r.vec_id: r for r in result.collect()}
    assert len(out) == len(x) + 8
    links = brute_links(x)
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= links.sum(1)).all()
    assert found.sum() >= 0.97 * links.sum()
    label = components(links)
    agree = np.mean([out[i].component_id == label[i] for i in range(len(x))])
    assert agree >= 0.97
    for i in range(5000, 5006):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values() if r.vec_id is not None)
    got, true = vecgraph.audit_recall(frame, result, 2000)
    assert true == links.sum() and got >= 0.97 * true


def test_large_group_of_near_copies_keeps_its_links(spark, monkeypatch):
    """A third of the rows are distinct near copies: they stay in one cluster, cut into parts and blocks."""
    monkeypatch.setattr(vecgraph, "PART", 60)
    monkeypatch.setattr(vecgraph, "BLOCK", 300, raising=False)
    rng = np.random.default_rng(2)
    hot = vecgraph.unit(rng.normal(size=(1, 64))) + rng.normal(size=(1000, 64)) * (0.25 / 8)
    x = np.concatenate([rng.normal(size=(2000, 64)), hot]).astype(np.float32)
    links = brute_links(x)
    assert links[2000:, 2000:].mean() > 0.99
    out = {r.vec_id: r for r in vecgraph.near_vectors(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    found, true = np.array([out[i].n_links for i in range(len(x))]), links.sum(1)
    assert (found <= true).all()
    assert found.sum() >= 0.99 * true.sum()
    assert {out[i].component_id for i in range(2000, 3000)} == {2000}


def test_vectors_of_odd_tables(spark):
    assert vecgraph.near_vectors(table(spark, [])).count() == 0
    rows = [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, 4.0]), (9, [-1.0, 5.0])]
    out = sorted(vecgraph.near_vectors(table(spark, rows)).collect())
    assert [(r.vec_id, r.n_links, r.component_id) for r in out] == [(3, 2, 3), (3, 2, 3), (4, 2, 3), (9, 0, 9)]
    one = vecgraph.near_vectors(table(spark, [(1, [0.0, -0.0]), (2, None)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in one) == [(1, 0, 1), (2, 0, 2)]


def test_pruning_keeps_the_nearest_and_shields_the_rest():
    v = vecgraph.unit(np.random.default_rng(1).normal(size=(200, 8)))
    graph = vecgraph.prune(v)
    cos = v @ v.T
    np.fill_diagonal(cos, -2)
    assert (graph[:, 0] == cos.argmax(1)).all()
    gap = np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0))
    for i in range(200):
        chosen = graph[i][graph[i] >= 0]
        assert len(set(chosen)) == len(chosen) and i not in chosen
        for k in range(1, len(chosen)):
            assert all(vecgraph.ALPHA * gap[s, chosen[k]] > gap[i, chosen[k]] - 1e-9 for s in chosen[:k])


def brute_top(x: np.ndarray, ids: np.ndarray, every: int, k: int) -> set:
    v = np.floor(64 * x.astype(float)).astype(np.int64)
    out = set()
    for i, q in zip(ids, v, strict=True):
        if i % every == 0:
            scored = sorted((-int(q @ c), j) for j, c in zip(ids, v, strict=True) if j != i)[:k]
            out |= {(int(i), r, int(j), -s) for r, (s, j) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("shard", "leaf"), [(16_384, 256), (300, 16)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(kdtopk, "SHARD", shard)
    monkeypatch.setattr(kdtopk, "LEAF", leaf)
    monkeypatch.setattr(kdtopk, "BLOCK", 40)
    monkeypatch.setattr(kdtopk, "FIRST", 3)
    x = np.round(sample(900, 100, 3), 1)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = table(spark, [*rows, *(r for r in odd_rows(50_000) if r[0] != 50_005 and r[0] != 50_001 and r[0] != 50_006)])
    out = {(r.query_id, r["rank"], r.vec_id, r.score) for r in kdtopk.top_k(frame).collect()}
    assert out == brute_top(x, np.arange(len(x)), 20, 20)


def test_top_k_counts_every_row_of_a_repeated_id(spark):
    """Rows that share a vec_id are candidates for each other and all queries; equal rows too."""
    rows = [(20, [1.0]), (20, [2.0]), (5, [3.0]), (5, [3.0]), (5, [0.5])]
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kdtopk.top_k(table(spark, rows)).collect())
    one, two = [(5, 12288), (5, 12288), (20, 8192), (5, 2048)], [(5, 24576), (5, 24576), (20, 8192), (5, 4096)]
    assert out == sorted((20, i, v, s) for scores in (one, two) for i, (v, s) in enumerate(scores, 1))


def test_a_walk_opens_boxes_best_first():
    """A query that already has a good kth score opens few leaves, and finds what brute force finds."""
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(4096, 4)))
    tree = kdtopk.plant(x, np.arange(4096), np.arange(4096))
    leaves = tree.child == 0
    assert (tree.end - tree.begin)[leaves].max() <= kdtopk.LEAF and sorted(tree.rows) == list(range(4096))
    for node in range(len(tree.begin)):
        here = tree.x[tree.begin[node] : tree.end[node]]
        assert (here.min(0) == tree.low[node]).all() and (here.max(0) == tree.high[node]).all()
    opened = []
    before, kdtopk.products = kdtopk.products, lambda q, x: opened.append(len(x)) or before(q, x)
    try:
        best = kdtopk.Best.of(np.array([kdtopk.NONE]), 5)
        kdtopk.walk(kdtopk.Tree.load(tree.dump()), x[:1], np.array([-1]), best, 0)
    finally:
        kdtopk.products = before
    assert best.scores[0].tolist() == sorted((x @ x[0]).astype(int), reverse=True)[:5]
    assert sum(opened) < 2048


def test_top_k_of_odd_tables(spark):
    assert kdtopk.top_k(table(spark, [])).count() == 0
    out = sorted(kdtopk.top_k(table(spark, [(0, [1.0, 1.0]), (20, [1.0]), (3, [0.5, -1.0]), (40, [])])).collect())
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 20, 4096), (0, 2, 40, 0), (0, 3, 3, -2048), (20, 1, 0, 4096), (20, 2, 3, 2048), (20, 3, 40, 0), (40, 1, 0, 0), (40, 2, 3, 0), (40, 3, 20, 0)]
    big = kdtopk.top_k(table(spark, [(0, [3e30, 1.0]), (1, [3e30, 2.0])])).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in big] == [(0, 1, 2**63 - 1)]
