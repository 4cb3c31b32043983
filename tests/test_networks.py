"""Lexicons across words and composed transducers, by enumeration."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from cadenza.operators import lexicon, storage, transducers

WORDS = [("ab", 0.5, ["a", "b"]), ("ab", 0.25, ["a", "c", "b"]), ("a", 1.0, ["a"]), ("cab", 1.0, ["c", "a", "b"]), ("bb", 0.5, ["b", "b"]), ("abca", 1.0, ["a", "b", "c", "a"]), ("e", 1.0, [])]
LEXICON = "word string, prob double, units array<string>"


def ways(arcs, start, ends, label, most, least=None):
    """(labels, words, weight) of all ways from start to an end with `most` words at most."""
    out: dict = {}
    for a in arcs:
        out.setdefault(a.src, []).append(a)
    todo = [(start, (), (), 1.0)]
    while todo:
        node, labels, words, prob = todo.pop()
        if node in ends:
            yield labels, words, prob
        for a in out.get(node, ()):
            said = (*words, a.word) if a.word else words
            if len(said) <= most:
                heard = (*labels, a[label]) if a[label] else labels
                if len(heard) <= 4 * (most + 1):
                    todo.append((a.dst, heard, said, prob * a.prob))


def spoken(words) -> tuple[str, ...]:
    units = [u for w in words for u in w]
    name = lambda i: (f"{units[i - 1]}-" if i else "") + units[i] + (f"+{units[i + 1]}" if i + 1 < len(units) else "")
    return tuple(name(i) for i in range(len(units)))


def test_triphones_across_words_equal_all_sequences(spark):
    frame = spark.createDataFrame(WORDS, LEXICON)
    arcs = lexicon.triphone_network(frame).collect()
    assert len({tuple(a) for a in arcs}) == len(arcs)
    found = {}
    for labels, words, prob in ways(arcs, "<s>", {"</s>"}, "triphone", 3):
        key = (labels, words)
        assert key not in found
        found[key] = prob
    given = [w for w in WORDS if w[2]]
    wanted = {}
    for n in (1, 2, 3):
        for said in itertools.product(given, repeat=n):
            wanted[spoken([w[2] for w in said]), tuple(w[0] for w in said)] = math.prod(w[1] for w in said)
    assert found == pytest.approx(wanted)
    # shared by all words that begin or end alike: fewer arcs than pairs of words have
    assert sum(a.dst == "a>b" for a in arcs) == len({"", "a", "b"})
    with pytest.raises(ValueError, match="units"):
        old, lexicon.MOST_UNITS = lexicon.MOST_UNITS, 1
        try:
            lexicon.triphone_network(frame)
        finally:
            lexicon.MOST_UNITS = old


def test_tied_states_say_the_same_and_are_shared(spark):
    frame = spark.createDataFrame(WORDS, LEXICON)
    arcs = lexicon.triphone_network(frame)
    names = {a.triphone for a in arcs.collect() if a.triphone}
    rng = random.Random(0)
    models = {n: [n.split("-")[-1].split("+")[0] + str(k) + rng.choice("xy") for k in range(2)] for n in names if rng.random() < 0.7}
    models |= {u: [f"{u}0", f"{u}1", f"{u}2"] for u in "abc"}
    states = lexicon.tied_states(arcs, spark.createDataFrame(list(models.items()), "name string, states array<string>")).collect()
    model = lambda n: models.get(n, models[n.split("-")[-1].split("+")[0]])
    found = {(labels, words): prob for labels, words, prob in ways(states, "<s>", {"</s>"}, "state", 2)}
    wanted: dict = {}
    for labels, words, prob in ways(arcs.collect(), "<s>", {"</s>"}, "triphone", 2):
        key = (tuple(s for n in labels for s in model(n)), words)
        if len(key[0]) <= 12:
            wanted[key] = prob
    assert {k: v for k, v in found.items() if len(k[0]) <= 12} == pytest.approx(wanted)
    # one node has one arc for each state
    keys = [(s.src, s.state) for s in states if s.state]
    assert len(keys) == len(set(keys))


def strings(arcs, finals, start, longest):
    """Counts and least weights of (input, output) over all ways of so many arcs at most."""
    out: dict = {}
    for a in arcs:
        out.setdefault(a[0], []).append(a)
    found: dict = {}
    todo = [(start, (), (), 0.0, 0)]
    while todo:
        node, x, y, w, n = todo.pop()
        if node in finals:
            count, least = found.get((x, y), (0, math.inf))
            found[x, y] = (count + 1, min(least, w + finals[node]))
        if n < longest:
            todo += [(b, (*x, i) if i else x, (*y, o) if o else y, w + v, n + 1) for _, b, i, o, v in out.get(node, ())]
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composed_ways_equal_pairs_of_ways(spark, seed):
    """Acyclic machines with empty labels on both sides: each pair of ways that agree is one way of the whole."""
    rng = random.Random(seed)
    label = lambda names: rng.choice([*names, None])
    arcs = lambda n, x, y: [(str(a), str(b), label(x), label(y), float(rng.randint(0, 5))) for a in range(n) for b in range(a + 1, n) for _ in range(2) if rng.random() < 0.6]
    left, right = arcs(5, "ab", "xy"), arcs(4, "xy", "pq")
    end = {"4": 1.0, "3": 0.5}, {"3": 2.0, "2": 0.25}
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string, input string, output string, weight double")
    final = lambda e: spark.createDataFrame(list(e.items()), "state string, weight double")
    got, ends = transducers.compose((frame(left), final(end[0])), (frame(right), final(end[1])), ("0", "0"))
    rows = [((*r.src,), (*r.dst,), r.input, r.output, r.weight) for r in got.collect()]
    finals = {(*r.state,): r.weight for r in ends.collect()}
    found = strings(rows, finals, ("0", "0", 0), 20)
    # by hand: all pairs of ways
    wanted: dict = {}
    first, second = ({}, {})
    for table, machine, e in ((first, left, end[0]), (second, right, end[1])):
        todo = [("0", (), (), 0.0)]
        while todo:
            node, x, y, w = todo.pop()
            if node in e:
                table.setdefault((x, y), []).append(w + e[node])
            todo += [(b, (*x, i) if i else x, (*y, o) if o else y, w + v) for a, b, i, o, v in machine if a == node]
    for (x, m), ws in first.items():
        for (k, y), vs in second.items():
            if m == k:
                count, least = wanted.get((x, y), (0, math.inf))
                wanted[x, y] = (count + len(ws) * len(vs), min(least, min(ws) + min(vs)))
    assert found == wanted and wanted
    kept = transducers.trimmed(got, ends).collect()
    live = {(*r.src,) for r in kept} | set(finals)
    assert all((*r.dst,) in live for r in kept)
    assert strings([((*r.src,), (*r.dst,), r.input, r.output, r.weight) for r in kept], finals, ("0", "0", 0), 20) == wanted
    storage.drop_rounds()
    assert storage.Rounds.made == []


def test_lexicon_and_grammar_accept_their_sentences(spark):
    sentences = [["ab", "a"], ["ab", "cab"], ["a"], ["ab", "a"]]
    grammar = transducers.sentence_grammar(spark.createDataFrame([(s,) for s in sentences], "words array<string>"))
    arcs, ends = transducers.compose(transducers.lexicon_transducer(spark.createDataFrame(WORDS, LEXICON)), grammar)
    found = strings([((*r.src,), (*r.dst,), r.input, r.output, r.weight) for r in arcs.collect()], {(*r.state,): r.weight for r in ends.collect()}, ("", "", 0), 6)
    nat = lambda p: -math.log(p)
    share = {("", "ab"): 0.75, ("", "a"): 0.25, ("ab", "a"): 2 / 3, ("ab", "cab"): 1 / 3, ("a", "</s>"): 1.0, ("cab", "</s>"): 1.0}
    wanted = {}
    for said in itertools.chain.from_iterable(itertools.product([w for w in WORDS if w[2]], repeat=n) for n in (1, 2)):
        names = ["", *(w[0] for w in said), "</s>"]
        steps = list(itertools.pairwise(names))
        if all(s in share for s in steps):
            weight = sum(nat(share[s]) for s in steps) + sum(nat(w[1]) for w in said)
            wanted[tuple(u for w in said for u in w[2]), tuple(names[1:-1])] = (1, pytest.approx(weight))
    assert found == wanted
