"""Statistics, lattices, searches, models and text against brute force and by their invariants."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import adaptation, lattice, ranks, search, segments, statistics, text
from cadenza.operators import language_model as lm
from cadenza.operators.groups import map_groups


def vectors(spark, n=200, dim=4, classes=3):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim)) + np.arange(n)[:, None] % classes
    return spark.createDataFrame([(i, i % classes, float(i % 2 + 1), v) for i, v in enumerate(x.tolist())], "id long, k int, g double, x array<double>"), x


def test_moments_of_parts_add_up(spark):
    df, x = vectors(spark)
    g = np.arange(200) % 2 + 1.0
    for full in (False, True):
        whole = {r.k: r for r in statistics.moments(df, "k", "x", "g", full).collect()}
        parts = statistics.moments(df.where("id < 70"), "k", "x", "g", full).union(statistics.moments(df.where("id >= 70"), "k", "x", "g", full))
        added = {r.k: r for r in statistics.add_moments(parts, "k").collect()}
        for k in range(3):
            at = np.arange(200) % 3 == k
            np.testing.assert_allclose(whole[k].sum1, g[at] @ x[at])
            second = (x[at] * g[at][:, None]).T @ x[at]
            np.testing.assert_allclose(whole[k].sum2, second[np.tril_indices(4)] if full else np.diag(second))
            np.testing.assert_allclose(added[k].sum2, whole[k].sum2)
            assert added[k].n == whole[k].n == at.sum()


def test_em_never_loses_likelihood_and_posteriors_add_up(spark):
    df, x = vectors(spark)
    m = statistics.Mixture.from_rows(statistics.gaussian_ml(statistics.moments(df, "k", "x", "g")), "k")
    np.testing.assert_allclose(m.posteriors(x)[0].sum(1), 1)
    last = -np.inf
    for _ in range(4):
        m, ll = statistics.em_step(df, "x", m)
        assert ll >= last - 1e-9
        last = ll
    more = statistics.split_largest(m, 5, 0.0)
    assert len(more.ids) == 5 and more.weights.sum() == pytest.approx(1)
    assert len(statistics.drop_light(more, 2.0).ids) == 1


def test_gamma_fit_is_a_maximum():
    d = np.random.default_rng(3).gamma(3.0, 2.0, 20_000)
    shape, scale = statistics.gamma_fit(d.mean(), np.log(d).mean())
    assert shape == pytest.approx(3, rel=0.05) and scale == pytest.approx(2, rel=0.05)


def test_transforms(spark):
    df, x = vectors(spark)
    a = adaptation.lda(df, "k", "x", "g", 2)
    y = x @ a.T
    centre = np.array([y[np.arange(200) % 3 == k].mean(0) for k in range(3)])
    assert np.linalg.norm(centre[0] - centre[2]) > 2
    mean, p = adaptation.pca(df, "x")
    np.testing.assert_allclose(np.cov(((x - mean) @ p.T).T, bias=True), np.eye(4), atol=1e-6)
    covs = np.array([np.cov(x[np.arange(200) % 3 == k].T) for k in range(3)])
    t = adaptation.mllt(covs, np.ones(3))
    assert abs(np.linalg.det(t)) == pytest.approx(1)
    off = lambda m: sum(np.abs(c - np.diag(np.diag(c))).sum() for c in m)
    assert off(np.einsum("ij,kjl,ml->kim", t, covs, t)) < off(covs)
    mixture = statistics.Mixture.from_rows(statistics.gaussian_ml(statistics.moments(df, "k", "x", "g")), "k")
    moved = df.withColumn("x", F.transform("x", lambda v: v * 2 + 1))
    w = adaptation.cmllr_transform(np.array(adaptation.cmllr_statistics(moved.withColumn("who", F.lit(1)), "who", "x", mixture).first().s), 4)
    z = np.array([r.x for r in moved.orderBy("id").collect()])
    score = lambda v, d: mixture.posteriors(v)[1].sum() + d * len(v)
    assert score(z @ w[:, 1:].T + w[:, 0], np.log(abs(np.linalg.det(w[:, 1:])))) > score(z, 0.0)


def test_exact_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1), strict=True))]
    out = ranks.exact_ranks(spark.createDataFrame(rows, "k int, v double, i int"), "k", "v", ["i"]).collect()
    for k in range(3):
        order = [(r[1], r[2]) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert {(r.v, r.i): r["rank"] for r in out if r.k == k} == {o: i for i, o in enumerate(order)}


def test_groups_that_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).select((F.floor(F.sqrt("id"))).alias("k"), F.col("id").alias("v"))

        def sums(table, begins):
            import pyarrow as pa

            v = np.asarray(table.column("v"))
            return pa.table({"k": [table.column("k")[int(b)].as_py() for b in begins[:-1]], "s": np.add.reduceat(v, begins[:-1])})

        out = {r.k: r.s for r in map_groups(df, "k", ["v"], sums, "k long, s long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == {r.k: r.s for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_lattice_by_hand(spark):
    """Two paths a-c and b-c with weights 1/4 and 3/4, and an arc that leads nowhere."""
    arcs = [(1, 0, 0, 1, np.log(0.25), 2.0), (1, 1, 0, 1, np.log(0.75), 6.0), (1, 2, 1, 3, 0.0, 1.0), (1, 3, 1, 2, 5.0, 9.0)]
    df = spark.createDataFrame([(n, a, s, d, float(w), v) for n, a, s, d, w, v in arcs], "net long, arc int, src int, dst int, score double, value double")
    out = {r.arc: r for r in lattice.path_scores(df).collect()}
    assert [round(out[a].posterior, 9) for a in range(4)] == [0.25, 0.75, 1.0, 0.0]
    assert all(r.total == pytest.approx(0) for r in out.values())
    assert [r.arc for r in lattice.best_paths(df).orderBy("place").collect()] == [1, 2]
    total = {r.arc: r.custom for r in lattice.path_values(df, "avg").collect()}
    assert total == pytest.approx({0: 3.0, 1: 7.0, 2: 6.0, 3: 0.0})
    errors = lattice.path_values(df, "avg")
    gamma = {r.arc: r.gamma for r in lattice.error_posteriors(lattice.path_scores(df), errors).collect()}
    assert gamma[0] < 0 < gamma[1]
    with pytest.raises(Exception, match="topological"):
        lattice.path_scores(df.withColumn("dst", F.lit(0))).collect()


def test_viterbi_and_forward_backward_by_enumeration(spark):
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(7, 3))
    path = search.viterbi_path(scores, np.log(0.6), np.log(0.4))
    options = []
    for jumps in itertools.combinations(range(1, 7), 2):
        p = np.searchsorted(jumps, np.arange(7), side="right")
        options.append((sum(scores[t, p[t]] for t in range(7)) + 4 * np.log(0.6) + 2 * np.log(0.4), p.tolist()))
    assert path.tolist() == max(options)[1]
    assert search.viterbi_path(scores[:2], 0.0, 0.0) is None
    x = rng.normal(size=6)
    start, move = np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    mean, var = np.array([-1.0, 1.0]), np.array([1.0, 2.0])
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)], "utt string, frame int, value double")
    out = search.state_posteriors(df, start, move, mean, var).orderBy("frame").collect()
    density = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
    mass, total = np.zeros((6, 2)), 0.0
    for y in itertools.product((0, 1), repeat=6):
        w = start[y[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(y)]) * np.prod([density[t, s] for t, s in enumerate(y)])
        total += w
        for t, s in enumerate(y):
            mass[t, s] += w
    np.testing.assert_allclose([r.posteriors for r in out], mass / total, atol=1e-9)
    assert out[0].ll == pytest.approx(np.log(total))


def test_decoder_finds_the_best_word_sequence(spark):
    rng = np.random.default_rng(4)
    units, lexicon = ["a", "b", "c"], [("ab", ("a", "b")), ("a", ("a",)), ("cb", ("c", "b")), ("c", ("c",))]
    unigram = {"ab": -1.0, "a": -1.5, "cb": -0.7, "c": -2.0, "</s>": -0.3}
    bigram = {("ab", "c"): -0.1, ("<s>", "a"): -0.4}
    scores = rng.normal(size=(5, 3)) * 2
    df = spark.createDataFrame([("u", t, s) for t, s in enumerate(scores.tolist())], "utt string, frame int, scores array<double>")
    found = search.decode(df, units, lexicon, bigram, unigram, {"a": -0.2}, 1.0, 1e9, 10_000).first()
    language = lambda a, b: bigram.get((a, b), {"a": -0.2}.get(a, 0.0) + unigram[b])
    best = None
    for n in range(1, 6):
        for ws in itertools.product(lexicon, repeat=n):
            seq = [u for _, us in ws for u in us]
            if len(seq) > 5:
                continue
            lm_score = sum(language(a, b) for a, b in itertools.pairwise(["<s>", *[w for w, _ in ws], "</s>"]))
            for cuts in itertools.combinations(range(1, 5), len(seq) - 1):
                at = np.searchsorted(cuts, np.arange(5), side="right")
                value = sum(scores[t, units.index(seq[at[t]])] for t in range(5)) + 4 * np.log(0.5) + lm_score
                best = max(best or (-np.inf, ""), (value, " ".join(w for w, _ in ws)))
    assert found.words == best[1] and found.score == pytest.approx(best[0])


def test_model_probabilities_add_up(spark):
    df = spark.createDataFrame([(0, "a b a c a b d e"), (1, "b a b b c f"), (2, "")], "id int, text string")
    s = lm.sentences(df, "id", "text")
    uni, bi = lm.backoff_model(lm.count_ngrams(s, "id", 1), lm.count_ngrams(s, "id", 2))
    contexts = spark.createDataFrame([("a",), ("b",), ("c",), ("<s>",)], "context string")
    assert all(r.total == pytest.approx(1, abs=1e-3) for r in lm.sums_to_one(lm.next_word_table(uni, bi, contexts)).collect())
    with pytest.raises(ValueError, match="add up"):
        lm.interpolated([(uni, 0.5)], ["word"])


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    assert text.word_distance(a, b) == row[-1]


def test_morph_segmentation_by_enumeration(spark):
    lp = {"a": -3.0, "u": -4.0, "t": -5.0, "o": -6.0, "au": -2.0, "to": -3.0, "auto": -4.0}
    pair = {("<w>", "au"): -0.1, ("au", "to"): -0.3, ("to", "<w>"): -0.2}
    words = spark.createDataFrame([(w,) for w in ("auto", "auuto", "bcd", "aaa", "")], "word string")
    out = {r.word: r for r in text.segment_words(words, lp, pair, {"u": -0.5}).collect()}
    score = lambda a, b: pair.get((a, b), lp.get(b, 0.0) + {"u": -0.5}.get(a, 0.0) if b in lp else 0.0)

    def splits(w):
        return [[]] if not w else [[w[:i], *rest] for i in range(1, len(w) + 1) if w[:i] in lp for rest in splits(w[i:])]

    for w in ("auto", "auuto", "aaa"):
        values = {" ".join(s): sum(score(a, b) for a, b in itertools.pairwise(["<w>", *s, "<w>"])) for s in splits(w)}
        assert out[w].morphs == max(values, key=values.get) and out[w].best == pytest.approx(max(values.values()))
        assert out[w].soft == pytest.approx(np.log10(sum(10**v for v in values.values())))
    assert out["bcd"].morphs is None and out[""].morphs is None
    assert text.spell_lattice("au  to", set(lp)) == [(0, 1, "a"), (0, 2, "au"), (1, 2, "u"), (2, 4, "<w>"), (4, 5, "t"), (4, 6, "to"), (5, 6, "o")]


def test_segments(spark):
    h = spark.createDataFrame([("u", 0, 100, "a"), ("u", 100, 110, "b"), ("v", 0, 5, "a")], "utt string, start int, end int, label string")
    r = spark.createDataFrame([("u", 0, 50, "a"), ("u", 50, 110, "b")], "utt string, start int, end int, label string")
    out = {(x.utt, x.start): x.score for x in segments.overlap_scores(h, r, 16).collect()}
    assert out["u", 0] == pytest.approx(1.0) and out["u", 100] == pytest.approx(-1 + 2 * 10 / 60) and out["v", 0] == -1
    labels = spark.createDataFrame([("a-b+c",), ("b+c",), ("a-b",), ("b",), ("_",), ("_x",), ("_-b",)], "l string")
    got = {x.l: (x.c, x.s) for x in labels.select("l", segments.centre_phone(F.col("l")).alias("c"), segments.is_silence(F.col("l")).alias("s")).collect()}
    assert [got[k][0] for k in ("a-b+c", "b+c", "a-b", "b")] == ["b"] * 4 and [k for k, v in got.items() if v[1]] == ["_", "_x"]
    assert labels.limit(1).select(segments.sublabel(F.lit("x;y"), 1), segments.sublabel(F.lit("x;y"), 2)).first()[:] == ("y", "")


def test_paths_longer_than_fifty_arcs_are_trimmed_and_pushed_whole(spark):
    n = 54
    arcs = spark.createDataFrame([(i, i + 1, i == n - 1, -1.0) for i in range(n)] + [(2, 900, False, 0.0)], "src int, dst int, final boolean, w double")
    kept = lm.trim_states(arcs, F.col("src") == 0)
    assert sorted(r.src for r in kept.collect()) == list(range(n))
    pushed = lm.push_weights(arcs.where("dst < 900")).collect()
    assert sorted(r.src for r in pushed) == list(range(n)) and {r.w for r in pushed} == {0.0 - 1.0 + 1.0}


def test_positive_cycles_cannot_be_pushed(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.0)], "src int, dst int, w double")
    with pytest.raises(ValueError, match="positive"):
        lm.push_weights(arcs)
