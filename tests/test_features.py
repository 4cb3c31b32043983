"""Frames, feature graphs and modules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import features as ft
from cadenza.operators.frames import in_order, padded, trimmed, with_length
from cadenza.plans.feature_graph import FeatureGraph, parse, register, render, to_dot

TEXT = """
module
{
  name base
  type pre
}
module
{
  name d
  type delta
  sources base
  width 2
}
module
{
  name dd
  type delta
  sources d
  width 3
}
module
{
  name all
  type merge
  sources base d dd
}
module
{
  name c
  type mean_subtractor
  sources all
  left 4
  right 2
}
"""


def frames(spark, lengths=(1, 2, 9, 40), dim=2):
    rng = np.random.default_rng(0)
    rows = [(u, f, rng.normal(size=dim).tolist()) for u, n in enumerate(lengths) for f in range(n)]
    return with_length(spark.createDataFrame(rows, "utt long, frame int, x array<double>")), rows


def reference(rows):
    """The same chain, frame by frame; outside an utterance its first and last frames go on."""
    utts: dict = {}
    for u, _, x in rows:
        utts.setdefault(u, []).append(np.array(x))

    def delta(get, width):
        norm = width * (width + 1) * (2 * width + 1) / 3
        return lambda t: sum(k * (get(t + k) - get(t - k)) for k in range(1, width + 1)) / norm

    out = {}
    for u, xs in utts.items():
        base = lambda t, xs=xs: xs[max(0, min(t, len(xs) - 1))]
        d = delta(base, 2)
        dd = delta(d, 3)
        merged = lambda t, b=base, d=d, dd=dd: np.concatenate([b(t), d(t), dd(t)])
        for t in range(len(xs)):
            out[u, t] = merged(t) - np.mean([merged(s) for s in range(t - 4, t + 3)], axis=0)
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_graph_equals_frame_by_frame(spark, block):
    """Also where utterances are cut into overlapping blocks."""
    df, rows = frames(spark)
    graph = FeatureGraph.from_text(TEXT)
    assert graph.context() == 2 + 3 + 4
    out, dim = graph.apply(df, 2, block)
    true = reference(rows)
    found = {(r.utt, r.frame): r.x for r in out.collect()}
    assert dim == 6 and found.keys() == true.keys()
    for k, x in found.items():
        np.testing.assert_allclose(x, true[k], atol=1e-9)


def test_only_one_shuffle_for_all_windows(spark):
    df = spark.createDataFrame([], "utt long, frame int, n int, x array<double>")
    out, _ = FeatureGraph.from_text(TEXT).apply(df.where("utt > 0"), 2)
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window") >= 3


def test_config_round_trip():
    modules = parse(TEXT)
    assert parse(render(modules)) == modules
    assert '"base" -> "d";' in to_dot(modules)


@pytest.mark.parametrize(("text", "said"), [("module\n{\nname a\ntype nothing\n}", "unknown"), ("module\n{\nname a\ntype pre\n}\nmodule\n{\nname a\ntype pre\n}", "twice"), ("module\n{\nname a\ntype delta\nsources b\n}", "declared before"), ("module\n{\nname a\ntype delta\n}", "no source"), ("module\n{\ntype pre\n}", "name")])
def test_faulty_graphs(text, said):
    with pytest.raises(ValueError, match=said):
        FeatureGraph.from_text(text)


def test_unused_modules_and_own_types(spark):
    register("twice", lambda m, v: (F.transform(v[0][0], lambda x: x * 2), v[0][1]))
    graph = FeatureGraph.from_text(TEXT + "module\n{\nname t\ntype twice\nsources base\n}")
    assert graph.unused() == ["d", "dd", "all", "c"] and graph.context() == 0
    df, rows = frames(spark)
    out = {(r.utt, r.frame): r.x for r in graph.apply(df, 2)[0].collect()}
    assert all(out[u, f] == [2 * v for v in x] for u, f, x in rows)


def test_padding_repeats_the_border_frames(spark):
    df, rows = frames(spark, (1, 3))
    p = sorted((r.utt, r.frame, tuple(r.x)) for r in padded(df, 2).select("utt", "frame", "x").distinct().collect())
    xs = {(u, f): tuple(x) for u, f, x in rows}
    assert p == sorted([(0, f, xs[0, 0]) for f in range(-2, 3)] + [(1, f, xs[1, max(0, min(2, f))]) for f in range(-2, 5)])
    assert trimmed(padded(df, 5, 2), 2).count() == 4
    assert in_order() is not None


def test_spectral_modules(spark):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(5, 33)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, x array<double>")

    def run(vector):
        return np.array([r.y for r in df.select("i", vector[0].alias("y")).orderBy("i").collect()])

    np.testing.assert_allclose(run(ft.vtln(F.col("x"), 33, 1.0, radius=0)), x)
    np.testing.assert_allclose(run(ft.vtln(F.col("x"), 33, 1.0, "blin")), x, atol=1e-12)
    np.testing.assert_allclose(run(ft.sr_norm(F.col("x"), 33, 11, 11, 1.0)), x, atol=1e-12)
    assert run(ft.vtln(F.col("x"), 33, 1.1, "slapt", params=(0.01, 0.02))).shape == (5, 33)
    np.testing.assert_allclose(run(ft.mel(F.col("x"), 33, 16000, root=True)), (x @ ft.mel_matrix(33, 16000).T) ** 0.1)
    assert ft.mel_dim(16000) == 21 and ft.mel_dim(8000) == 15
    np.testing.assert_allclose(ft.mel_matrix(129, 16000).sum(1), 1)
    np.testing.assert_allclose(run(ft.vtln_all_pass(F.col("x"), 33, 1.0)), x, atol=1e-9)
    wave = np.hamming(33)
    np.testing.assert_allclose(run(ft.fft(F.col("x"), 33)), np.abs(np.fft.rfft(x * wave)), atol=1e-9)
