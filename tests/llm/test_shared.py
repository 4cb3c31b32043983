"""Helpers: running sums, components, remembered pre-tokens."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.llm import bpe
from cadenza.llm.components import connected_components
from cadenza.llm.shared import Scratch, hash_share, running_before, text_chunks


def test_forgetting_changes_no_ids():
    model = bpe.BpeModel(bpe.read_model(str(public_tokenizers.path("byte_bpe_50k.json"))))
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    whole, short = model.encoder(), model.encoder()
    short.remembered = 25
    want, at = whole(pa.array(texts))
    for i, t in enumerate(texts):
        ids, _ = short(pa.array([t, None, ""]))
        assert ids.tolist() == want[at[i] : at[i + 1]].tolist()


def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(0)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 - k) for k in range(1, 300)] + [(5000 + int(a), 5000 + int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(7, 7)]
    label: dict[int, int] = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a long, b long")
    for forest in (False, True):
        out = {r.id: r.component_id for r in connected_components(frame, Scratch(spark, "test"), forest).collect()}
        assert all(out.get(i, i) == c for i, c in label.items())
    assert connected_components(frame.limit(0), Scratch(spark, "test")).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "b"]), rng.randint(0, 99), i, rng.randint(0, 9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, o long, i long, v long").withColumn("bucket", F.expr("o div 7"))
    out = {r.i: (r.s, r.x) for r in running_before(frame, ["k"], "bucket", [F.col("o"), F.col("i")], {"s": ("sum", "v"), "x": ("bit_xor", "i")}).collect()}
    for k, o, i, _ in rows:
        before = [r for r in rows if r[0] == k and (r[1], r[2]) < (o, i)]
        x = 0
        for r in before:
            x ^= r[2]
        assert out[i] == (sum(r[3] for r in before), x)


def test_chunks_and_samples(spark):
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 5]})
    pieces = list(text_chunks([batch], limit=20))
    assert [p.column("text").to_pylist() for p in pieces] == [["a" * 10, None], ["b" * 100, ""], ["c" * 5]] or sum(p.num_rows for p in pieces) == 5
    n = spark.range(10_000).where(hash_share("id") < 0.1).count()
    assert 800 < n < 1200
