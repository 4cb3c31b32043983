"""Errors of arcs against reference lattices, and numbers of network nodes, by enumeration."""

from __future__ import annotations

import itertools
import random

import pytest

from cadenza.operators import errors, networks

HYP = "net int, arc int, start int, end int, label string"
REF = "net int, arc int, src int, dst int, start int, end int, label string"


def values(spark, hyps, refs, modes, **more):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = errors.arc_errors(frame(hyps, HYP), frame(refs, REF), modes, width=8, **more).collect()
    return {(r.net, r.arc): tuple(r[m.replace("-", "_")] for m in modes) for r in out}


def centre(label: str) -> str:
    left, plus = label.rfind("-"), label.find("+")
    if plus < 0:
        plus = label.find(";", max(left, 0))
    if left >= 0 and plus > left + 1:
        found = label[left + 1 : plus]
    elif plus >= 0:
        found = label[:plus]
    else:
        found = label[left + 1 :] if left >= 0 else label
    return found or label


def test_centre_phones_count_and_chains_add_up(spark):
    refs = [(0, 0, 0, 1, 0, 10, "x-b+y"), (0, 1, 1, 2, 10, 20, "b-c+y")]
    hyps = [(0, 0, 0, 10, "a-b+c"), (0, 1, 0, 20, "a-b+c"), (0, 2, 40, 50, "a-b+c"), (0, 3, 10, 20, "a-b+c")]
    out = values(spark, hyps, refs, ["mwe", "mpe", "snfe"])
    assert out == {(0, 0): (0.0, 1.0, 0.0), (0, 1): (0.0, 1.0, -1.0), (0, 2): (-1.0, -1.0, -1.0), (0, 3): (0.0, 0.0, -1.0)}


def reference_lattice(rng: random.Random, net: int) -> list[tuple]:
    times = sorted(rng.sample(range(1, 40), 8))
    times = [0, *times, 40]
    arcs, n = [], 0
    for a in range(len(times) - 1):
        for b in sorted({a + 1, *(x for x in range(a + 2, min(a + 4, len(times))) if rng.random() < 0.4)}):
            for _ in range(rng.choice([1, 1, 2])):
                arcs.append((net, n, a, b, times[a], times[b], f"{rng.choice('pq')}-{rng.choice('abc')}+{rng.choice('pq')};s;m{rng.choice('abc')};{rng.choice(['sil', 'w'])}"))
                n += 1
    return arcs


def chains(refs, start, end):
    """All ways through references over [start, end) that begin where no other one of them leads."""
    over = [r for r in refs if r[4] < end and start < r[5]]
    first = [r for r in over if not any(q[3] == r[2] for q in over)]
    todo = [[r] for r in first]
    while todo:
        way = todo.pop()
        yield way
        todo += [[*way, r] for r in over if r[2] == way[-1][3]]


def test_errors_equal_enumerated_reference_paths(spark):
    rng = random.Random(1)
    refs, hyps = [], []
    for net in range(12):
        refs += reference_lattice(rng, net)
        for k in range(25):
            a = rng.randrange(0, 39)
            hyps.append((net, k, a, min(40, a + rng.randint(1, 20)), f"{rng.choice('pq')}-{rng.choice('abc')}+{rng.choice('pq')};s;m{rng.choice('abc')};{rng.choice(['sil', 'w'])}"))
    out = values(spark, hyps, refs, ["mwe", "mpe", "snfe"])
    quiet = values(spark, hyps, refs, ["mpe"], silence="sil")
    for net, k, a, b, label in hyps:
        mine = [r for r in refs if r[0] == net]
        share = [((min(b, r[5]) - max(a, r[4])) / (r[5] - r[4]), r[6]) for r in mine if r[4] < b and a < r[5]]
        assert out[net, k][0] == pytest.approx(max(-1 + e * (1 + (x == label)) for e, x in share))
        assert out[net, k][1] == pytest.approx(max(-1 + e * (1 + (centre(x) == centre(label))) for e, x in share))
        cost = lambda r: 0.0 if centre(r[6]) == centre(label) else -(min(b, r[5]) - max(a, r[4])) / min(b - a, r[5] - r[4])  # noqa: E731, B023
        assert out[net, k][2] == pytest.approx(max(sum(map(cost, way)) for way in chains(mine, a, b) if way[-1][5] >= b))
        assert quiet[net, k][0] == (0.0 if label.endswith(";sil") else out[net, k][1])


def test_frame_errors_by_states(spark):
    transitions = spark.createDataFrame([(t, t // 2, t // 2 % 3) for t in range(12)], "transition int, state int, pdf int")
    phones = spark.createDataFrame([(f"m{p}", [2 * i, 2 * i + 1]) for i, p in enumerate("abc")], "phone string, states array<int>")
    rng = random.Random(3)
    label = lambda: f"{rng.randrange(14)};s;m{rng.choice('abcd')};w"
    refs = [(0, t, t, t + 1, t, t + 1, label()) for t in range(60)] + [(0, 100 + t, t, t + 1, t, t + 1, label()) for t in range(60)]
    hyps = [(0, t, t, t + 1, label()) for t in range(60)] + [(0, 60, 70, 71, label())]
    out = values(spark, hyps, refs, ["mpfe-pdf", "mpfe-cps", "mpfe"], transitions=transitions, phones=phones)
    states = {f"m{p}": {2 * i, 2 * i + 1} for i, p in enumerate("abc")}
    number = lambda x: int(x.split(";")[0])
    for _, arc, start, _, mine in hyps:
        over = [r[6] for r in refs if r[4] == start]
        by_pdf = any(number(r) < 12 and number(mine) < 12 and number(r) // 2 % 3 == number(mine) // 2 % 3 for r in over)
        by_reference = any(number(mine) in states.get(r.split(";")[2], ()) for r in over)
        by_hypothesis = any(number(r) < 12 and number(r) // 2 in states.get(mine.split(";")[2], ()) for r in over)
        assert out[0, arc] == (by_pdf, by_reference, by_hypothesis)
    with pytest.raises(ValueError, match="mpx"):
        values(spark, hyps, refs, ["mpx"])


def test_networks_have_exactly_the_paths_of_their_pronunciations(spark):
    """Pronunciations of 60 units, and 25 of one word: no path mixes them."""
    long = [["a"] * 60, ["b"] * 60, ["b"] * 59 + ["a"]]
    many = [[f"u{k}", f"v{k}"] for k in range(25)]
    lexicon = spark.createDataFrame([("w", 0.5, u) for u in long] + [("m", 0.1, u) for u in many] + [("o", 1.0, ["x"])], "word string, prob double, units array<string>")
    words = spark.createDataFrame([(1, 0, "w"), (1, 1, "m"), (1, 2, "o"), (1, 3, "w")], "k int, at int, word string")
    arcs = [(r.src, r.dst, r.unit, r.word) for r in networks.transcript_network(words, "k", "at", "word", lexicon).collect()]
    out: dict[int, list] = {}
    for a in arcs:
        out.setdefault(a[0], []).append(a)
    last = max(a[1] for a in arcs)
    found, todo = set(), [(0, ())]
    while todo:
        node, units = todo.pop()
        if node == last:
            found.add(units)
        todo += [(b, (*units, u)) for _, b, u, _ in out.get(node, ())]
    assert found == {(*a, *b, "x", *c) for a, b, c in itertools.product(map(tuple, long), map(tuple, many), map(tuple, long))}


def test_states_of_long_arcs_do_not_share_nodes(spark):
    units = spark.createDataFrame([(0, k, k, k + 1, "u", 0.0) for k in range(3)], "net int, arc int, src int, dst int, unit string, score double")
    rows = [(r.src, r.dst) for r in networks.state_network(units, states=120).collect()]
    moves = [r for r in rows if r[0] != r[1]]
    assert len(moves) == 360 and len({a for a, _ in moves}) == 360 and len({b for _, b in moves}) == 360
