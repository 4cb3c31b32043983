"""Snapshot collapse and rendering of conversations."""

from __future__ import annotations

import random

from cadenza.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, a int, range string"


def brute(rows) -> dict:
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(t))
    seqs = {c: tuple((r, t) for _, r, t in sorted(v, key=key)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        same = [d for d, o in seqs.items() if o == s and d is not None]
        if not longer and (c == (min(same) if same else None)):
            out[c] = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in s)
    return out


def test_maximal_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        n = rng.randint(1, 12)
        base = [(t, ["user", "assistant", None][t % 3 if t % 5 else 2], rng.choice(["hi", "", None, "ok", "go on"])) for t in range(n)]
        for k in sorted({n, rng.randint(1, n), rng.randint(1, n)}):
            conv = len({r[0] for r in rows})
            rows += [(conv, *t) for t in base[:k]]
            if rng.random() < 0.3:
                rows += [(conv + 1, *t) for t in base[:k]]
    rows += [(900, None, "user", "a"), (900, 1, "user", "b"), (900, 1, "user", "b"), (None, 0, "user", "lost"), (901, 0, "user", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, "p", 1, "q") for r in rows], SCHEMA).repartition(5)
    out = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert {c: r.rendered for c, r in out.items()} == brute(rows)
    assert out[900].n_turns == 3
    assert chat.format_chats(frame.limit(0)).count() == 0
