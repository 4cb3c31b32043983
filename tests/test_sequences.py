"""Lattices from frames, windows of alignment, n-grams of any order, and estimates, against plain recomputation."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import discriminative, lattice, networks, ranks, search, statistics, trees, trellis
from cadenza.operators import language_model as lm
from cadenza.plans import catalogue
from cadenza.sources import files

SF = "/root/testdata/sf0.001"


def test_path_values_of_a_lattice_worked_by_hand(spark):
    """Two arcs from 1 to 2 with values 1 and 3, one from 2 to 3 with 10, all of score 0; arc 9 is on no path."""
    rows = [(0, 0, 1, 2, 0.0, 1.0), (0, 1, 1, 2, 0.0, 3.0), (0, 2, 2, 4, 0.0, 10.0), (0, 9, 3, 4, 0.0, 5.0)]
    arcs = spark.createDataFrame(rows, "net int, arc int, src int, dst int, score double, value double")
    want = {"sum": [11, 13, 14, 0], "avg": [11, 13, 12, 0], "max": [11, 13, 13, 0]}
    for how, values in want.items():
        got = {r.arc: r.custom for r in lattice.path_values(arcs, how).collect()}
        assert [got[a] for a in (0, 1, 2, 9)] == pytest.approx(values)
    uneven = spark.createDataFrame([(0, 0, 1, 2, math.log(3), 1.0), (0, 1, 1, 2, 0.0, 3.0), (0, 2, 2, 3, 0.0, 10.0)], arcs.schema)
    assert {r.arc: r.custom for r in lattice.path_values(uneven, "avg").collect()}[2] == pytest.approx(11.5)


def test_values_are_handed_down(spark):
    logical = spark.createDataFrame([(0, 0, math.log(3), 2.0), (0, 1, 0.0, 6.0)], "net int, arc int, total double, custom double")
    children = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 1, 8)], "net int, arc int, child int")
    for how, seven in (("avg", 3.0), ("sum", 8.0), ("max", 6.0)):
        assert {r.child: r.custom for r in lattice.handed_down(logical, children, how).collect()} == pytest.approx({7: seven, 8: 6.0})


def network():
    arcs = [(0, 1, 0, "a", -0.2), (1, 1, 0, "", -0.5), (1, 2, 1, "b", -0.9), (2, 2, 1, "", -0.4), (2, 1, 0, "a", -1.1), (0, 2, 1, "b", -1.3)]
    return trellis.Network.of(arcs, 0, 2)


def test_lattices_of_frames_hold_what_paths_score(spark):
    net = network()
    rng = np.random.default_rng(1)
    logs = rng.normal(size=(6, 2)) * 2
    paths = []
    for way in itertools.product(range(len(net.src)), repeat=6):
        if net.src[way[0]] == 0 and net.dst[way[-1]] == 2 and all(net.dst[a] == net.src[b] for a, b in itertools.pairwise(way)):
            paths.append((way, sum(net.score[a] + logs[t, net.pdf[a]] for t, a in enumerate(way))))
    scores = np.array([s for _, s in paths])
    frame = spark.createDataFrame([(5, t, x.tolist()) for t, x in enumerate(logs)], "utt long, frame int, logs array<double>")
    everything = trellis.create_lattices(frame, net, 1e6).collect()
    assert everything[0].whole == pytest.approx(np.logaddexp.reduce(scores))
    for r in everything:
        through = [s for way, s in paths if net.src[way[r.frame]] == r.src and net.dst[way[r.frame]] == r.dst]
        assert r.total == pytest.approx(np.logaddexp.reduce(through))
    best = trellis.create_lattices(frame, net, 1e6, mode="best").collect()
    assert best[0].whole == pytest.approx(scores.max())
    narrow = trellis.create_lattices(frame, net, 1e-9, mode="best").orderBy("frame").collect()
    top = paths[int(scores.argmax())][0]
    assert [(r.src, r.dst) for r in narrow] == [(net.src[a], net.dst[a]) for a in top]
    multi = trellis.create_lattices(frame, net, 1e6, mode="multipath").collect()
    assert multi[0].whole == pytest.approx(everything[0].whole)
    # stretches of labels: each path is a chain of them
    logical = trellis.logical_lattices(trellis.create_lattices(frame, net, 1e6)).collect()
    table = {(r.start, r.end, r.src, r.dst, r.label): r.score for r in logical}
    for way, _ in paths:
        begins = [t for t, a in enumerate(way) if net.label[a]]
        for t, u in zip(begins, [*begins[1:], 6], strict=True):
            score = sum(net.score[way[k]] + logs[k, net.pdf[way[k]]] for k in range(t, u))
            assert table[t, u, int(net.src[way[t]]), int(net.dst[way[u - 1]]), net.label[way[t]]] == pytest.approx(score)
    assert trellis.create_lattices(frame.limit(0), net, 5.0).count() == 0


def test_windows_of_alignment(spark):
    """One window is the whole alignment; small ones hold its order, lose no frame, and end in the last label."""
    rng = np.random.default_rng(2)
    means, variances = {"a": 0.0, "b": 5.0, "c": 10.0}, dict.fromkeys("abc", 1.0)
    rows, names, truth = [], [], {}
    for u in range(4):
        labels = [("a", "b", "c")[i % 3] for i in range(12 + u)]
        states = np.repeat(np.arange(len(labels)), rng.integers(1, 9, len(labels)))
        truth[u] = states
        names.append((u, labels))
        rows += [(u, t, float(means[labels[s]] + rng.normal() * 0.2)) for t, s in enumerate(states)]
    rows += [(9, 0, 0.0), (9, 1, 0.0)]
    names += [(9, ["a", "b", "c"]), (10, ["a"])]
    frames = spark.createDataFrame(rows, "utt long, frame int, value double")
    labels = spark.createDataFrame(names, "utt long, labels array<string>")
    whole = {(r.utt, r.frame): r.state for r in search.align(frames.join(labels, "utt"), means, variances, beam=1e9, most=1e9).collect()}
    for window in (1000, 20, 7):
        got = trellis.align_windows(frames, labels, means, variances, window=window).collect()
        assert {(r.utt, r.frame): r.state for r in got} == {k: s for k, s in whole.items() if k[0] != 9}
        assert all(truth[r.utt][r.frame] == r.state for r in got)


def test_ranks_of_a_whole_table(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 10**6, 2000).tolist()
    ranked, n = ranks.global_ranks(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    assert n == 2000 and [r.v for r in ranked.orderBy("rank").collect()] == sorted(values)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(2000))
    for rows in (0, 3, 10, 11):
        frame = spark.range(rows).withColumnRenamed("id", "v")
        sizes = {r.batch: r["count"] for r in files.batches(frame, "v", 4).groupBy("batch").count().collect()}
        assert [sizes.get(b, 0) for b in (1, 2, 3, 4)] == [rows // 4 + (b <= rows % 4) for b in (1, 2, 3, 4)]


def brute_backoff(sents: list[list[str]], order: int, discount: float = 0.5):
    """Probabilities by definition, from counts."""
    counts = [{} for _ in range(order)]
    for words in sents:
        for i in range(1, len(words)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    g = tuple(words[i - n + 1 : i + 1])
                    counts[n - 1][g] = counts[n - 1].get(g, 0) + 1
    total = sum(counts[0].values())

    def p(context: tuple, word: str, interpolated: bool) -> float:
        n = len(context) + 1
        if n == 1:
            return counts[0].get((word,), 0) / total
        seen = {g[-1]: c for g, c in counts[n - 1].items() if g[:-1] == context}
        lower = p(context[1:], word, interpolated)
        if not seen:
            return lower
        t = sum(seen.values())
        own = max(seen.get(word, 0) - discount, 0) / t
        if interpolated:
            return own + discount * len(seen) / t * lower
        if word in seen:
            return own
        return discount * len(seen) / t / max(1 - sum(p(context[1:], w, False) for w in seen), 1e-10) * lower

    return p, {g[0] for g in counts[0]}


def test_ngrams_of_order_four(spark):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(list("abcd"), rng.integers(1, 9), p=[0.5, 0.3, 0.15, 0.05]))) for i in range(60)]
    sents = lm.sentences(spark.createDataFrame(texts, "id long, text string"), "id", "text").cache()
    words = [r.words for r in sents.orderBy("id").collect()]
    p, vocabulary = brute_backoff(words, 4)
    counts = [lm.count_ngrams(sents, "id", n) for n in (1, 2, 3, 4)]
    rows = lm.histories(sents, "id", 4)
    extra = spark.createDataFrame([("d d d", "a"), ("zz a", "b"), ("", "c"), ("a", "zz")], "context string, word string")
    asked = rows.select("context", "word").union(extra)
    for interpolated in (False, True):
        model = lm.ngram_model(counts, interpolated=interpolated).cache()
        for r in lm.model_scores(asked, model, 4, interpolated).collect():
            true = p(tuple(r.context.split()), r.word, interpolated)
            assert r.lp == (pytest.approx(math.log10(true)) if true > 0 else -99.0)
        if interpolated:
            for r in lm.to_backoff(model, 4).where("lp > -99").collect():
                assert r.lp == pytest.approx(math.log10(min(1.0, p(tuple(r.context.split()), r.word, True))))
        else:
            for n in (2, 3, 4):
                for r in lm.probability_sums(model, n).collect():
                    assert r.total == pytest.approx(sum(p(tuple(r.context.split()), w, False) for w in vocabulary))
            for r in lm.extensions(model).where("n = 3").collect():
                lps = [s.lp for s in r.words]
                assert lps == sorted(lps, reverse=True)


def test_walks_of_an_automaton_are_back_off_probabilities(spark):
    sents = lm.sentences(spark.createDataFrame([(0, "a b a"), (1, "b b"), (2, "a c")], "id long, text string"), "id", "text")
    model = lm.ngram_model([lm.count_ngrams(sents, "id", n) for n in (1, 2, 3)]).cache()
    p, _ = brute_backoff([r.words for r in sents.collect()], 3)
    asked = lm.sentences(spark.createDataFrame([(0, "a b b"), (1, "c c"), (2, ""), (3, "a z")], "id long, text string"), "id", "text")
    found = {r.id: r.score for r in lm.walk_automaton(lm.automaton_text(model), asked.select("id", F.slice("words", 2, 99).alias("words")), "id").collect()}
    assert set(found) == {0, 1, 2}
    for i, words in ((0, ["<s>", "a", "b", "b", "</s>"]), (1, ["<s>", "c", "c", "</s>"]), (2, ["<s>", "</s>"])):
        assert found[i] == pytest.approx(-sum(math.log(p(tuple(words[max(0, k - 2) : k]), words[k], False)) for k in range(1, len(words))))


def test_long_chains_are_followed_to_their_ends(spark):
    """More rounds than a fixed limit of 50 would allow, and a cycle that never ends."""
    arcs = spark.createDataFrame([(i, i + 1, i == 54, 1.0) for i in range(55)], "src int, dst int, final boolean, w double").coalesce(1).cache()
    assert lm.trim_states(arcs, F.col("src") == 0).count() == 55
    pushed = lm.push_weights(arcs.where("src >= 45").select("src", "dst", "w")).collect()
    assert len(pushed) == 10 and all(abs(r.w) < 1e-9 for r in pushed)
    loop = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.0)], "src int, dst int, w double")
    with pytest.raises(ValueError, match="positive weight"):
        lm.push_weights(loop)


def test_runs_in_blocks_and_numbers_by_day(spark):
    """Runs that cross blocks, gaps, nulls; a user with most events has the numbers of a plain window."""
    from pyspark.sql import Window

    from cadenza.operators import frames, segments

    rng = np.random.default_rng(7)
    rows = [(u, t, [None, "a", "b"][int(x)]) for u in range(3) for t, x in enumerate(np.repeat(rng.integers(0, 3, 40), rng.integers(1, 12, 40))) if t % 50 != 13]
    frame = spark.createDataFrame(rows, "utt int, frame int, label string")
    want, before = [], None
    for u, t, label in rows:
        if before == (u, t - 1, label):
            want[-1][2] = t + 1
        else:
            want.append([u, t, t + 1, label])
        before = (u, t, label)
    for block in (1, 7, 64, 4096):
        got = segments.label_runs(frame, block=block).collect()
        assert sorted(map(str, ([r.utt, r.start, r.end, r.label] for r in got))) == sorted(map(str, want))
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 10 > 0, F.lit(None)).otherwise(F.col("user_id")))
    plain = events.select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"))
    assert sorted(map(tuple, frames.numbered(events, event_id=F.col("event_id")).select("event_id", "frame").collect())) == sorted(map(tuple, plain.collect()))


def test_null_vectors_do_not_count(spark):
    rows = [(0, [1.0, 2.0], 1.0), (0, None, 1.0), (0, [3.0, None], 1.0), (1, [5.0, 6.0], None), (1, [1.0, 1.0], 2.0)]
    m = statistics.moments(spark.createDataFrame(rows, "k int, x array<double>, g double"), "k", "x", "g")
    assert {r.k: (r.n, r.gamma, r.sum1) for r in m.collect()} == {0: (1, 1.0, [1.0, 2.0]), 1: (1, 2.0, [2.0, 2.0])}


def test_gamma_models_need_enough_durations(spark):
    rng = np.random.default_rng(5)
    d = rng.integers(1, 12, 400)
    rows = [(0, int(x)) for x in d] + [(1, 3)] + [(2, 4)] * 30
    out = {r.s: r for r in statistics.gamma_models(spark.createDataFrame(rows, "s int, d int"), "s", "d", least=20).collect()}
    assert (out[1].shape, out[1].scale) == (0.0, 0.0)
    grid = np.linspace(1.0, 2 * max(d.mean() ** 2 / d.var(ddof=1), 1.5) - 1, 20_000)
    value = grid * np.log(grid / d.mean()) - np.array([math.lgamma(a) for a in grid]) + (grid - 1) * np.log(d).mean() - grid
    assert out[0].shape == pytest.approx(grid[value.argmax()], abs=1e-3) and out[0].shape * out[0].scale == pytest.approx(d.mean())
    # equal durations: the variance is taken as 0.25
    assert out[2].shape == pytest.approx(2 * 16 / 0.25 - 1, rel=1e-3)


def test_limited_updates_and_splits():
    rng = np.random.default_rng(6)
    mean, variance = rng.normal(size=4), rng.uniform(0.5, 2, 4)
    num = (50.0, 50 * (mean + 0.5), 50 * (variance + (mean + 0.5) ** 2))
    den = (30.0, 30 * mean, 30 * (variance + mean**2))
    for limit in (1e-3, 1e-2, 10.0):
        m, v, d = discriminative.ebw_limited(num, den, mean, variance, limit)
        assert discriminative.divergence(m, v, mean, variance) <= limit * (1 + 1e-6) and (v > 0).all()
        if limit < 1:
            assert discriminative.divergence(m, v, mean, variance) == pytest.approx(limit, rel=1e-3)
    occupancies = np.array([1000.0, 200.0, 50.0, 3.0])
    for count in (4, 8, 16):
        got = statistics.split_counts(occupancies, count, 5.0)
        assert got.sum() <= count and (got >= 1).all() and (np.diff(got) <= 0).all() and got[3] == 1


def test_clusters_and_leaves_recomputed(spark):
    """Each Gaussian is in the nearest cluster; leaves part what their split leaves apart."""
    v, mixture = catalogue.statistics_queries._mixture(spark, SF)
    label = statistics.cluster_gaussians(mixture, 4)
    found = {r.label: r.cluster for r in catalogue.QUERIES["gmm_cluster"](spark, SF).collect()}
    assert found == dict(zip(mixture.ids, label.tolist(), strict=True))
    names = np.unique(label)
    means = np.array([mixture.means[label == c].mean(0) for c in names])
    variances = np.array([mixture.variances[label == c].mean(0) for c in names])
    kld = 0.5 * (np.log(variances[None] / mixture.variances[:, None]) + (mixture.variances[:, None] + (mixture.means[:, None] - means[None]) ** 2) / variances[None] - 1).sum(-1)
    assert (names[kld.argmin(1)] == label).all()
    leaf = trees.regression_tree(mixture.means, mixture.weights, 4)
    assert {r.label: r.leaf for r in catalogue.QUERIES["regression_tree"](spark, SF).collect()} == dict(zip(mixture.ids, leaf.tolist(), strict=True))
    assert sorted(set(leaf.tolist())) == [0, 1, 2, 3]
    spread = lambda at: mixture.weights[at] @ ((mixture.means[at] - np.average(mixture.means[at], 0, mixture.weights[at])) ** 2).sum(1)
    assert sum(spread(leaf == k) for k in range(4)) < spread(np.ones(len(leaf), bool))


def test_grammars_with_closures(spark):
    grammar = spark.createDataFrame([(0, 1, "a"), (1, 2, "!NULL"), (2, 0, "!NULL"), (2, 3, "b"), (1, 1, "c")], "src int, dst int, word string")
    sentences = spark.createDataFrame([(0, ["a", "a", "c", "b", "a"]), (1, ["b"]), (2, []), (3, None), (4, ["a", "b"])], "id int, words array<string>")
    assert {r.id: r.matched for r in networks.accepts_prefix(grammar, sentences, "id").collect()} == {0: 4, 1: 0, 2: 0, 3: 0, 4: 2}
