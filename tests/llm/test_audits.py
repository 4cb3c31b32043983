"""The audit of filters, the manifest and the license scan against plain Python on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cadenza.llm import filters, license_rules, licenses, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, `set` int, n long, idx long, labels string"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "z", 7, 7, 7, "z") for r in rows], SCHEMA)


def texts() -> list[tuple]:
    """Rows that fail every mix of filters: null and empty texts, copies, repeated and null ids."""
    rng = random.Random(5)
    rows = []
    for i in range(80):
        n = rng.choice([3, 150, 199, 200, 260])
        distinct = rng.choice([0.3, 0.5, 0.9])
        words = [f"w{k}" for k in range(max(1, int(n * distinct)))]
        text = " ".join(words[k % len(words)] for k in range(n))
        if i % 3 == 0:
            text += " " + "ABC " * (n // 3)
        if i % 4 == 0:
            text += rng.choice("#$%&*|")
        rows.append((i, text, None, ("x", "y", None, "")[i % 4]))
    rows += [(90 + i, rows[i % 7][1], None, "x") for i in range(20)]
    rows += [rows[3], rows[3], (3, rows[3][1], None, "y"), (3, "other", None, "y"), (None, rows[3][1], None, "x"), (None, None, None, None), (7, None, None, "q"), (8, "", None, "q"), (6, "   \t\n", None, "q")]
    return rows


def audit_by_hand(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = [r[1] or "" for r in rows]
    firsts: dict[str, int] = {}
    for r, t in zip(rows, text, strict=True):
        if r[0] is not None:
            firsts[t] = min(firsts.get(t, r[0]), r[0])

    def fails(r, t):
        w = word.findall(t)
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and firsts[t] < r[0],
        }

    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    docs = [(r[3] or "", fails(r, t), r[0] in good and r[0] is not None, r[0] in toxic and r[0] is not None) for r, t in zip(rows, text, strict=True)]
    out, removed_in_all = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                removed_in_all[part, letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(d[1][letter] for d in mine) - len(gone), sum(d[1][letter] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_filters_applied_in_turn(spark):
    rows = texts()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (5, None, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filters.filter_audit(table(spark, rows), frame).collect()}
    assert out == audit_by_hand(rows, labels)
    assert filters.filter_audit(table(spark, []), frame).count() == 0
    none = filters.filter_audit(table(spark, rows), frame.where("false")).agg(F.max("good_lost"), F.max("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_copies_of_one_text_are_few_rows_before_they_meet(spark):
    """A text that most rows hold: after the first sums it is one row a part and labels."""
    rows = [(i, "same text", None, ("x", "y")[i % 2]) for i in range(400)] + [(1000 + i, f"t{i}", None, "x") for i in range(50)]
    weighted = filters.weighted_failures(table(spark, rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    out = weighted.collect()
    assert len(out) == 50 + 3 and sum(r.n for r in out) == 450
    assert sum(r.n_repeated for r in out) == 399


def by_hand(rows):
    """Leaves, trees and proofs straight from their definition."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return h("".join(map(field, (r[0], r[3], r[2], len(r[1] or ""), text))))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // 16 * 16
            out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
            i //= 16
        return out

    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for r in rows:
        start = leaf(r, lower(r[1])) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r, r[1])
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), start, r[0]))
    trees = {s: grow([x[2] for x in sorted(g)]) for s, g in groups.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = grow([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, start, doc) in enumerate(sorted(groups[s])):
            way = path(trees[s], i) + path(top, k)
            folded = start
            for a, b in way:
                folded = h(a + folded + b)
            out.append((doc, own, trees[s][-1][0], root, h("".join(a + b for a, b in way)), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 16, 17, 400])
def test_manifest_equals_its_definition(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 60)
    rng = random.Random(n)
    sources = [None, "", "b", "a", "ä", "\U0001f600", "ﬀ", *[f"s{k}" for k in range(14)]] if n > 20 else ["b", None][: max(1, n // 17 + 1)]
    rows = [(rng.randrange(300), rng.choice(["Some Text", "ÀB", "", None, "x" * 5000]), rng.choice(["en", None]), sources[0] if i % 3 == 0 else rng.choice(sources)) for i in range(n)]
    if n > 20:
        rows += [rows[0]] * 70 + [(None, "A null Id", "en", "b"), (None, None, None, None)] + [(9, f"T{i}", None, "a") for i in range(40)]
    frame = table(spark, rows)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text")))
    out = merkle.proofs(merkle.manifest(frame, tampered))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, by_hand(rows)))


def test_paths_verify_a_row_without_its_tree(spark):
    """A leaf, its path and the root are enough; no changed text folds to the root."""
    rows = [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)]
    found = merkle.manifest(table(spark, rows), F.concat("text", F.lit("!"))).collect()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in found:
        for start, same in ((r.leaf, True), (r.changed, False)):
            for p in r.path:
                start = h(p.preimage[: 64 * p.slot] + start + p.preimage[64 * p.slot + 64 :])
            assert (start == r.root) == same


def scan_by_hand(text):
    """All rules at all words, and all pairs of detections."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for i in range(len(words)):
        rest = " ".join(words[i : i + license_rules.longest() + 5])
        for r in license_rules.rules():
            if m := re.match(f"({r.pattern})(?: |$)", rest):
                hits.append((i, i + m[1].count(" "), r))
    better = lambda o, x: o[0] <= x[0] and o[1] >= x[1] and (o[2].priority, o[1] - o[0], -o[2].number) > (x[2].priority, x[1] - x[0], -x[2].number)
    kept = [x for x in hits if not any(better(o, x) for o in hits)]
    base = [x for x in hits if x[2].priority == license_rules.BASE]
    names = lambda found: {x[2].label for x in found}
    starts = [x[0] for x in base]
    score = max((license_rules.STRENGTH[x[2].priority] for x in kept), default=0.0)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names(base))), ",".join(sorted(names(base) | names(kept))), score


STATEMENTS = (
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3 or any later version.",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "MIT license MIT LICENSE mit licence",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "Redistribution and use in source and binary forms, with or without modification",
    "the general public license and the lesser general public license",
    "Copyright (c) 2019 All rights reserved.",
    "mozilla public license 2.0 mpl 1.1 epl-2.0 (EUPL v1.2) cc0 1.0 BSD-3-Clause",
    "LİCENSE mıt license KMIT LICENSE licenſe apache license apache license",
    "mit license" * 3,
    "mit license\x00apache-license_general.public/license",
)


def license_texts() -> list[str | None]:
    rng = random.Random(2)
    out: list[str | None] = [None, "", "   ", "no terms here", *STATEMENTS]
    vocabulary = sorted({w for s in STATEMENTS for w in s.split()}) + ["und", "mit", "der"]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 40]))) for _ in range(60)]
    out += [" ".join([rng.choice(STATEMENTS) for _ in range(30)])]
    out.append("mit license " * 3000 + "gpl " * 2000)
    return out


def test_license_scan_tries_all_rules_everywhere(spark):
    given = license_texts()
    frame = table(spark, [(i, t, None, None) for i, t in enumerate(given)])
    out = {r.doc_id: tuple(r)[1:] for r in licenses.summarize(licenses.scan(frame)).collect()}
    for i, t in enumerate(given[:-1]):
        assert out[i] == scan_by_hand(t), t
    assert out[len(given) - 1] == (8000, 3000, 0, 5998, "mit", "gpl,mit", 1.0)


def test_every_rule_passes_the_gate_and_has_keywords():
    """Matches drawn from each rule: they hold a gate, begin with a keyword and fit the longest rule."""
    rng = random.Random(4)

    def draw(pattern: str) -> str:
        while m := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
            choice = "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))
            pattern = pattern[: m.start()] + choice + pattern[m.end() :]
        pattern = re.sub(r"\[0-9\]", lambda m: rng.choice("0123456789"), pattern)
        return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", pattern)

    numbers = [r.number for r in license_rules.rules()]
    assert len(numbers) >= 200 and len(set(numbers)) == len(numbers)
    for r in license_rules.rules():
        for _ in range(40):
            text = draw(r.pattern)
            assert re.fullmatch(r.pattern, text), (r, text)
            words = text.split(" ")
            assert words[0] in license_rules.first_words(r.pattern) and len(words) <= r.span <= license_rules.longest()
            assert r.need in text
            assert any(g in w for g in license_rules.GATES for w in words) or set(words) & set(license_rules.SHORT_GATES), (r, text)


def test_license_scan_is_built_in_functions_alone(spark):
    plan = licenses.summarize(licenses.scan(table(spark, [(1, "x", None, None)])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "from_json" not in plan.split("== Optimized Logical Plan ==")[1]
