"""Beams by histogram against a plain replay; lattices of the decoder against enumeration."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from cadenza.operators import lattice, pruning, search

UNITS = ["a", "b", "c"]
LEXICON = [("A", ("a",)), ("AB", ("a", "b")), ("AB", ("a", "c", "b")), ("C", ("c",)), ("BA", ("b", "a"))]
WORDS = ["A", "AB", "BA", "C"]
UNIGRAM = {"A": -1.0, "AB": -1.4, "BA": -0.9, "C": -2.0, "</s>": -0.7}
BIGRAM = {("<s>", "A"): -0.3, ("A", "BA"): -0.2, ("C", "AB"): -0.6, ("BA", "</s>"): -0.1}
BACKOFF = {"A": -0.4, "<s>": -0.1}
LEAVE = math.log(0.5)


def plain_next(scores: list[float], beam: float, width: float, most: int) -> tuple[float, float]:
    """The rule, one token at a time."""
    best, limit = max(scores), max(scores) - beam
    if len(scores) <= most:
        return limit, min(width, beam * 1.1)
    low = max(min(scores), limit)
    step = (best - low) / 99
    live = [s for s in scores if s >= limit]
    if step == 0 or len(live) <= most:
        return limit, beam
    bins = [0] * 100
    for s in live:
        bins[min(99, int((s - low) / step))] += 1
    left, cut = len(live), 98
    for i in range(98 + 1):
        left -= bins[i]
        if left < most:
            cut = i
            break
    least = min(low + (cut + 1) * step, best)
    return least, min(best - least, width)


def test_beams_equal_a_plain_replay(spark):
    rng = random.Random(0)
    rows = []
    for utt in range(6):
        for t in range(40):
            n = rng.choice([1, 3, 8, 30])
            rows += [(utt, t, rng.choice([rng.gauss(0, 40), -5.0])) for _ in range(n)] if t != 7 else [(utt, t, -1.0)] * 12
    frame = spark.createDataFrame(rows, "utt int, frame int, score double")
    out = {(r.utt, r.frame): (r.beam, r.least, r.kept) for r in pruning.frame_beams(frame, 100.0, 6).collect()}
    narrowed = 0
    for utt in range(6):
        beam = 100.0
        for t in range(40):
            scores = [s for u, f, s in rows if u == utt and f == t]
            least, after = plain_next(scores, beam, 100.0, 6)
            assert out[utt, t] == pytest.approx((beam, least, sum(s >= least for s in scores)))
            narrowed += after < beam
            beam = after
    assert narrowed > 20
    # the same rule over tables, one frame at a time
    beams = spark.createDataFrame([(u, 100.0) for u in range(5)], "utt int, beam double")
    for t in range(4):
        now = frame.where(f"frame = {t}")
        kept, beams = pruning.histogram_prune(now, "utt", "score", beams, 100.0, 6)
        found = {r.utt: r.beam for r in beams.collect()}
        assert sorted((r.utt, r.score) for r in kept.collect()) == sorted((u, s) for u, f, s in rows if f == t and s >= out[u, t][1])
        assert found == pytest.approx({u: out[u, t + 1][0] for u in range(6)})
        beams = spark.createDataFrame(list(found.items()), "utt int, beam double")


def test_token_steps_share_the_beam(spark):
    tokens = spark.createDataFrame([(u, 0, "", 0.0) for u in range(2)], "utt int, node int, history string, score double")
    arcs = spark.createDataFrame([(0, k, "x", f"w{k}", -float(k % 13)) for k in range(1, 40)], "src int, dst int, unit string, word string, weight double")
    scores = spark.createDataFrame([(u, "x", -1.0) for u in range(2)], "utt int, unit string, lp double")
    beams = spark.createDataFrame([(0, 50.0)], "utt int, beam double")
    kept, after = search.token_step_by_histogram(tokens, arcs, scores, beams, 50.0, 10)
    values = [-1.0 - k % 13 for k in range(1, 40)]
    least, beam = plain_next(values, 50.0, 50.0, 10)
    assert sorted(r.score for r in kept.collect()) == sorted(2 * [v for v in values if v >= least])
    assert {r.utt: r.beam for r in after.collect()} == pytest.approx({0: beam, 1: beam})


def frames(spark, seed: int, lengths: list[int]):
    rng = np.random.default_rng(seed)
    rows = [(u, t, [float(x) for x in -3 * rng.random(3)]) for u, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "utt int, frame int, scores array<double>"), {u: np.array([r[2] for r in rows if r[0] == u]) for u in range(len(lengths))}


def lm(a: str, b: str) -> float:
    return BIGRAM[a, b] if (a, b) in BIGRAM else BACKOFF.get(a, 0.0) + UNIGRAM[b]


def said(word: str, matrix: np.ndarray, a: int, b: int) -> float:
    """The best way to say a word in frames a .. b - 1, with what leaving it costs unless they are the last."""
    best = -np.inf
    for name, units in LEXICON:
        if name != word or len(units) > b - a:
            continue
        s = np.full(len(units), -np.inf)
        s[0] = matrix[a, UNITS.index(units[0])]
        for t in range(a + 1, b):
            step = np.concatenate([[-np.inf], s[:-1]]) + LEAVE
            s = np.maximum(step, s + LEAVE) + [matrix[t, UNITS.index(u)] for u in units]
        best = max(best, s[-1] + (LEAVE if b < len(matrix) else 0.0))
    return best


def whole_scores(matrix: np.ndarray) -> dict[tuple[str, ...], float]:
    """The best score of each sequence of words."""
    n = len(matrix)
    span = {(w, a, b): said(w, matrix, a, b) for w in WORDS for a in range(n) for b in range(a + 1, n + 1)}
    out: dict[tuple[str, ...], float] = {}
    todo = [((), 0, 0.0)]
    while todo:
        way, at, score = todo.pop()
        if at == n:
            out[way] = max(out.get(way, -np.inf), score + lm(way[-1], "</s>"))
            continue
        for w in WORDS:
            for b in range(at + 1, n + 1):
                if np.isfinite(span[w, at, b]):
                    todo.append(((*way, w), b, score + span[w, at, b] + lm(way[-1] if way else "<s>", w)))
    return out


def paths(arcs: list, score=lambda history, word, arc: arc.score):
    """All ways through a lattice: words and scores."""
    out_of: dict[int, list] = {}
    for a in arcs:
        out_of.setdefault(a.src, []).append(a)
    last = max(a.dst for a in arcs)
    todo = [((), 0, 0.0)]
    while todo:
        words, node, total = todo.pop()
        if node == last:
            yield words, total
        todo += [((*words, a.word), a.dst, total + score(words, a.word, a)) for a in out_of.get(node, ())]


@pytest.mark.parametrize("few", [4096, 4])
def test_lattices_hold_the_best_way_of_each_last_pair(spark, monkeypatch, few):
    monkeypatch.setattr(search._Ends, "FEW", few)
    lengths = [6, 1, 5, 4]
    frame, matrices = frames(spark, 3, lengths)
    options = {"beam": 1e9, "most": 100_000}
    best = {r.utt: (r.words, r.score) for r in search.decode(frame, UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, **options).collect()}
    found: dict[int, list] = {}
    for r in search.decode(frame, UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, lattice=True, **options).collect():
        found.setdefault(r.net, []).append(r)
    assert set(found) == set(range(len(lengths)))
    for u, arcs in found.items():
        n, at = len(matrices[u]), {0: 0}
        at |= {a.dst: a.frame for a in arcs}
        assert [a.arc for a in sorted(arcs, key=lambda a: a.arc)] == list(range(len(arcs)))
        for a in arcs:
            assert a.src < a.dst and a.score == pytest.approx(a.am + a.lm)
            if a.word != "</s>":
                assert a.am == pytest.approx(said(a.word, matrices[u], at[a.src], a.frame))
        true = whole_scores(matrices[u])
        assert best[u][1] == pytest.approx(max(true.values()))
        assert tuple(best[u][0].split()) == max(true, key=true.get)
        ways: dict[tuple, float] = {}
        for words, total in paths(arcs):
            assert words[-1] == "</s>" and total <= true[words[:-1]] + 1e-9
            pair = words[-3:-1]
            ways[pair] = max(ways.get(pair, -np.inf), total)
        wanted: dict[tuple, float] = {}
        for words, total in true.items():
            wanted[words[-2:]] = max(wanted.get(words[-2:], -np.inf), total)
        assert ways == pytest.approx(wanted)
        assert max(a.frame for a in arcs) == n


def test_lattices_rescored_with_three_words_equal_enumeration(spark):
    frame, _ = frames(spark, 5, [6, 7, 3])
    arcs = search.decode(frame, UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, beam=6.0, lattice=True)
    trigram = lambda history, word: -1.0 - 0.3 * len(set(history[-2:]) | {word}) - 0.1 * len(word)
    grown = lattice.expand_histories(arcs.select("net", "arc", "src", "dst", "word", "am"), 3).withColumnRenamed("src_history", "history")
    histories = {(r.history, r.word) for r in grown.collect()}
    table = spark.createDataFrame([(h, w, trigram(tuple(h.split()), w)) for h, w in histories], "history string, word string, lp double")
    rows = lattice.numbered_states(lattice.rescored(grown, table, 1.5))
    got = {r["net"]: r["sum(score)"] for r in lattice.best_paths(rows).groupBy("net").sum("score").collect()}
    found: dict[int, list] = {}
    for r in arcs.collect():
        found.setdefault(r.net, []).append(r)
    for u, mine in found.items():
        assert got[u] == pytest.approx(max(total for _, total in paths(mine, lambda h, w, a: a.am + 1.5 * trigram(h, w))))


def plain_decode(matrix: np.ndarray, beam: float, most: int) -> tuple[str, float]:
    """Token passing by dictionaries, with the beam of the replay; scores without looking ahead are those with it at the root."""
    arcs, words = search.prefix_tree(LEXICON)
    ahead = search.lookahead(arcs, words, UNIGRAM)
    name = {n: u for next_ in arcs.values() for u, n in next_.items()}
    tokens = {(0, "<s>"): (ahead[0], ())}
    width = beam
    for t, frame in enumerate(matrix):
        from_ = [(n, last, s + (LEAVE if t else 0.0), way) for (n, last), (s, way) in tokens.items()]
        ended: dict[str, tuple] = {}
        if t:
            for n, last, s, way in from_:
                for w in words.get(n, []):
                    v = (s - ahead[n] + lm(last, w) + ahead[0], (*way, w))
                    ended[w] = max(ended.get(w, (-np.inf, ())), v)
        from_ += [(0, w, s, way) for w, (s, way) in ended.items()]
        new: dict[tuple, tuple] = {}
        for n, last, s, way in from_:
            for u, k in arcs[n].items():
                v = (s - ahead[n] + ahead[k] + frame[UNITS.index(u)], way)
                new[k, last] = max(new.get((k, last), (-np.inf, ())), v)
        for (n, last), (s, way) in tokens.items():
            if n:
                v = (s + LEAVE + frame[UNITS.index(name[n])], way)
                new[n, last] = max(new.get((n, last), (-np.inf, ())), v)
        least, width = plain_next([s for s, _ in new.values()], width, beam, most)
        tokens = {k: v for k, v in new.items() if v[0] >= least}
    ends = [(s - ahead[n] + lm(last, w) + lm(w, "</s>"), (*way, w)) for (n, last), (s, way) in tokens.items() for w in words.get(n, [])]
    return (" ".join(max(ends)[1]), max(ends)[0]) if ends else ("", search.ZERO)


def test_decoding_with_few_tokens_equals_a_plain_search(spark):
    frame, matrices = frames(spark, 11, [30, 25, 12, 40, 1])
    for beam, most in itertools.product((4.0, 30.0), (4, 9)):
        out = {r.utt: (r.words, r.score) for r in search.decode(frame, UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, beam=beam, end_beam=1e9, most=most).collect()}
        for u, matrix in matrices.items():
            words, score = plain_decode(matrix, beam, most)
            assert out[u] == (words, pytest.approx(score)), (u, beam, most)
