"""Training in rounds: sums by enumeration, likelihoods that never fall, and going on from stored sums."""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
import pytest

from cadenza.operators import training
from cadenza.operators.training import MODEL, States, Training, expect

UNITS = ["a", "b", "c"]


def start(spark, components=2, states=2, dim=2):
    rng = np.random.default_rng(9)
    rows = [(s, k, 1 / components, rng.normal(size=dim).tolist(), [1.5] * dim, 0.3 + 0.05 * s) for s in range(len(UNITS) * states) for k in range(components)]
    return spark.createDataFrame(rows, MODEL)


def by_hand(x, chain, model):
    """All alignments one by one: likelihood, occupancies of each Gaussian and frame, stays and leaves."""
    frames, places = len(x), len(chain)
    total, occupancy = 0.0, np.zeros((frames, places, model.weights.shape[1]))
    stays, leaves = np.zeros(places), np.zeros(places)
    for cut in itertools.combinations(range(1, frames), places - 1):
        edge = [0, *cut, frames]
        ways = 1.0
        shares = []
        for k in range(places):
            s = chain[k]
            n = edge[k + 1] - edge[k]
            ways *= model.stay[s] ** (n - 1) * (1 - model.stay[s])
            for t in range(edge[k], edge[k + 1]):
                p = model.weights[s] * np.exp(-0.5 * (np.log(2 * np.pi * model.variances[s]) + (x[t] - model.means[s]) ** 2 / model.variances[s]).sum(-1))
                ways *= p.sum()
                shares.append((t, k, p / p.sum()))
        total += ways
        for t, k, p in shares:
            occupancy[t, k] += ways * p
        stays += ways * (np.diff(edge) - 1)
        leaves += ways
    return np.log(total), occupancy / total, stays / total, leaves / total


def test_expectation_equals_all_alignments(spark):
    model = States.of(start(spark))
    rng = np.random.default_rng(1)
    for frames, chain in ((6, [0, 1, 4, 5]), (5, [2, 2, 3]), (4, [0, 1, 2, 3]), (1, [3])):
        x = rng.normal(size=(frames, 2))
        got, true = expect(x, np.array(chain), model), by_hand(x, chain, model)
        for a, b in zip(got, true, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-10)
    assert expect(rng.normal(size=(2, 2)), np.array([0, 1, 2]), model) is None


def corpus(spark, n=40):
    rng = np.random.default_rng(4)
    means = rng.normal(size=(3, 2, 2)) * 3
    frames, labels = [], []
    for u in range(n):
        said = [UNITS[rng.integers(3)] for _ in range(rng.integers(1, 4))]
        t = 0
        for name in said:
            for s in range(2):
                for _ in range(rng.integers(1, 5)):
                    frames.append((u, t, (means[UNITS.index(name), s] + rng.normal(size=2)).tolist()))
                    t += 1
        labels.append((u, said))
    labels += [(n, ["a", "b", "c"]), (n + 1, ["a", "zzz"])]  # too short, and a unit that is not known
    frames += [(n, 0, [0.0, 0.0]), (n + 1, 0, [0.0, 0.0]), (n + 1, 1, [0.0, 0.0])]
    table = spark.createDataFrame(frames, "utt int, frame int, x array<double>")
    return training.with_chains(table, spark.createDataFrame(labels, "utt int, labels array<string>"), UNITS, 2)


def model_rows(df):
    return {(r.state, r.component): (r.weight, r.stay, *r.mean, *r.variance) for r in df.collect()}


def test_likelihood_never_falls_and_stopped_training_goes_on(spark, tmp_path):
    frames, first = corpus(spark), start(spark)
    whole = Training(spark, str(tmp_path / "whole"), batches=3)
    last = model_rows(whole.run(frames, first, 5))
    history = {r.round: r for r in whole.history(5).collect()}
    scores = [history[r].log_likelihood for r in range(1, 6)]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(scores)) and scores[-1] > scores[0] + 10
    assert {(r.utterances, r.lost) for r in history.values()} == {(40, 2)}
    # one round by hand, over the stored model
    states = States.of(first)
    occupancy, sums, n = np.zeros((6, 2)), np.zeros((6, 2, 2)), 0.0
    utts: dict = {}
    for r in frames.orderBy("utt", "frame").collect():
        utts.setdefault(r.utt, []).append(r)
    for rows in list(utts.values())[:40]:
        x = np.array([r.x for r in rows])
        ll, gamma, _, _ = expect(x, np.array(rows[0].chain), states)
        n += ll
        np.add.at(occupancy, np.array(rows[0].chain), gamma.sum(0))
        np.add.at(sums, np.array(rows[0].chain), np.einsum("tsk,td->skd", gamma, x))
    assert n == pytest.approx(history[1].log_likelihood)
    one = model_rows(spark.read.parquet(str(tmp_path / "whole" / "model-1")))
    for (s, k), row in one.items():
        assert row[0] == pytest.approx(occupancy[s, k] / occupancy[s].sum()) and row[2:4] == pytest.approx(tuple(sums[s, k] / occupancy[s, k]))
    # stopped in the third round: what is stored is not made again
    calls = []

    class Stopped(Training):
        def _once(self, name, make):
            if name.startswith("sums-3/1") and not calls:
                calls.append(name)
                raise KeyboardInterrupt
            return super()._once(name, make)

    part = Stopped(spark, str(tmp_path / "part"), batches=3)
    with pytest.raises(KeyboardInterrupt):
        part.run(frames, first, 5)
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path / "part").rglob("*.parquet")}
    assert any("sums-3" in str(p) for p in before)
    again = model_rows(Training(spark, str(tmp_path / "part"), batches=3).run(frames, first, 5))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert again.keys() == last.keys() and all(again[k] == pytest.approx(last[k]) for k in last)
    # sums of two runs are those of one over both
    a, b = (training.add_sums(spark.read.parquet(*[str(tmp_path / "whole" / f"sums-1/{i}") for i in which])) for which in ((0, 1), (2,)))
    joined = {(r.kind, r.state, r.component): r for r in training.add_sums(a.union(b)).collect()}
    for r in whole.sums(1).collect():
        other = joined[r.kind, r.state, r.component]
        assert (other.n, other.lost) == (r.n, r.lost) and other.first == pytest.approx(r.first) and list(other.sum2) == pytest.approx(list(r.sum2))


def test_lost_utterances_are_tried_with_wider_beams(spark):
    frames, first = corpus(spark), States.of(start(spark))
    u = lambda **beams: training.sums_of(frames, first, **beams).where("kind = 'u'").first()
    narrow, wide, exact = u(beam=0.2, most=0.2), u(beam=0.2, most=1e4), u()
    assert narrow.lost > 2 and wide.lost == exact.lost == 2 and wide.n == 40
    assert wide.first <= exact.first + 1e-9
