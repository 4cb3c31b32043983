"""Feature graphs and decoding over streams equal those over tables, with frames late, repeated and missing."""

from __future__ import annotations

import time

import numpy as np
import pytest
from test_decoder import BACKOFF, BIGRAM, LEXICON, UNIGRAM, UNITS

from cadenza.operators.search import Decoder, decode
from cadenza.plans.feature_graph import FeatureGraph
from cadenza.streaming.decoding import streaming_decode
from cadenza.streaming.graphs import stream_graph

GRAPH = """
module { 
  name base
  type pre
}
module {
  name d
  type delta
  width 2
  sources base
}
module {
  name dd
  type delta
  width 1
  sources d
}
module {
  name all
  type merge
  sources base d dd
}
module {
  name near
  type concat
  left 1
  right 2
  sources all
}
module {
  name centred
  type mean_subtractor
  left 3
  right 1
  sources near
}
"""


def stream(spark, folder, rows, schema, seed, size):
    order = np.random.default_rng(seed).permutation(len(rows))
    for i in range(0, len(rows), size):
        spark.createDataFrame([rows[j] for j in order[i : i + size]], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def until(seconds, ready):
    end = time.time() + seconds
    while time.time() < end and not ready():
        time.sleep(0.5)


def test_any_graph_over_a_stream_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = [1, 2, 9, 30, 25]
    rows = [(u, f, rng.normal(size=2).tolist(), f == n - 1) for u, n in enumerate(lengths) for f in range(n)]
    given = [r for r in rows if r[:2] != (4, 15)] + rows[5:9]  # one frame never comes, some come twice
    schema = "utt long, frame int, x array<double>, closed boolean"
    graph = FeatureGraph.from_text(GRAPH)
    out = str(tmp_path / "out")
    write = lambda df, n: df.write.mode("append").parquet(out)
    q = stream_graph(stream(spark, tmp_path / "in", given, schema, 3, 17), graph, 2, write).option("checkpointLocation", str(tmp_path / "cp")).start()
    # the utterance with the gap gives what frames 0 .. 14 allow
    wanted = {(u, f) for u, n in enumerate(lengths) for f in range(n) if u < 4 or f < 15 - graph.context()}
    try:
        until(150, lambda: q.exception() is not None or ((tmp_path / "out").exists() and spark.read.schema("utt long, frame int, x array<double>").parquet(out).count() >= len(wanted)))
        assert q.exception() is None
        got = {(r.utt, r.frame): r.x for r in spark.read.schema("utt long, frame int, x array<double>").parquet(out).collect()}
    finally:
        q.stop()
    assert set(got) == wanted
    n = {u: k for u, k in enumerate(lengths)}
    table = spark.createDataFrame([(u, f, n[u], x) for u, f, x, _ in rows], "utt long, frame int, n int, x array<double>")
    true, dim = graph.apply(table, 2)
    for r in true.collect():
        if (r.utt, r.frame) in got:
            assert len(got[r.utt, r.frame]) == dim
            if r.utt < 4 or r.frame + graph.context() < 15:
                np.testing.assert_allclose(got[r.utt, r.frame], r.x, atol=1e-12)


def test_decoding_a_stream_ends_with_the_words_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    lengths = [1, 6, 20, 33, 12]
    rows = [(u, f, (-3 * rng.random(3)).tolist(), f == n - 1) for u, n in enumerate(lengths) for f in range(n)]
    given = [r for r in rows if r[:2] != (4, 7)]
    options = {"scale": 1.2, "beam": 12.0, "most": 9, "end_beam": 8.0}
    decoder = Decoder(UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, **options)
    frames = stream(spark, tmp_path / "in", given, "utt long, frame int, scores array<double>, closed boolean", 5, 14)
    q = streaming_decode(frames, decoder).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        until(150, lambda: q.exception() is not None or spark.table("said").where("final").count() >= 4)
        assert q.exception() is None
        found = spark.table("said").collect()
    finally:
        q.stop()
    table = spark.createDataFrame([r[:3] for r in rows], "utt long, frame int, scores array<double>")
    true = {r.utt: (r.words, r.score) for r in decode(table, UNITS, LEXICON, BIGRAM, UNIGRAM, BACKOFF, **options).collect()}
    assert {r.utt: (r.words, pytest.approx(r.score)) for r in found if r.final} == {u: true[u] for u in range(4)}
    assert {r.frames for r in found if r.final and r.utt == 3} == {33}
    # partial results are those of as many frames
    partial = [r for r in found if not r.final]
    assert partial and max(r.frames for r in partial if r.utt == 4) <= 7
    for r in partial:
        tokens = decoder.begin(1)
        for t in range(r.frames):
            decoder.advance(tokens, t, np.array([x for u, f, x, _ in rows if (u, f) == (r.utt, t)]))
        words, score = decoder.so_far(tokens).get(0, ((), -1e15))
        assert (r.words, r.score) == (" ".join(words), pytest.approx(score))
