"""Readers and writers round trip; streaming features equal batch ones."""

from __future__ import annotations

import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars
from cadenza.sources import files
from cadenza.streaming.frames import WINDOWS, streaming_delta, streaming_features


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_recipe(spark, tmp_path):
    p = write(tmp_path / "r", "audio=a.wav speaker=s1 start-time=1.5\n\naudio=b.wav\tend-line=7\n")
    rows = files.read_recipe(spark, p).orderBy("audio").collect()
    assert [(r.audio, r.speaker, r.start_time, r.end_line) for r in rows] == [("a.wav", "s1", 1.5, None), ("b.wav", None, None, 7)]
    with pytest.raises(Exception, match="Invalid recipe line"):
        files.read_recipe(spark, write(tmp_path / "bad", "audio\n")).collect()


def test_segments_round_trip(spark, tmp_path):
    p = write(tmp_path / "s", "0 1280 a-b+c.2 some words\n1280 2560 _\nlone rest\n")
    rows = files.read_segments(spark, p)
    got = [(r.start, r.end, r.labels, r.state, r.comment) for r in rows.collect()]
    assert got == [(0, 10, ["a-b+c"], 2, "some words"), (10, 20, ["_"], -1, ""), (-1, -1, ["lone"], -1, "rest")]
    back = "\n".join(r.value for r in files.segment_lines(rows).collect())
    again = files.read_segments(spark, write(tmp_path / "t", back)).drop("file").collect()
    assert again == rows.drop("file").collect()
    with pytest.raises(Exception, match="invalid start or end"):
        files.read_segments(spark, write(tmp_path / "bad", "500 100 a\n")).collect()


def test_speakers(spark, tmp_path):
    text = "speaker default\n{\n  vtln\n  {\n    warp 1.0\n  }\n}\nspeaker anna\n{\n  vtln\n  {\n    warp 0.9\n    turn 0.8 0.7\n  }\n}\n"
    rows = [tuple(r) for r in files.read_speakers(spark, write(tmp_path / "k", text)).collect()]
    assert ("speaker", "anna", "vtln", "turn", ["0.8", "0.7"]) in rows and len(rows) == 3
    assert files.parse_speakers("", files.speaker_text(rows).encode()) == rows
    recipe = spark.createDataFrame([("anna",), ("ben",)], "speaker string")
    params = spark.createDataFrame([("anna", 0.9), ("default", 1.0)], "speaker string, value double")
    assert {r.speaker: r.value for r in files.with_speakers(recipe, params).collect()} == {"anna": 0.9, "ben": 1.0}
    with pytest.raises(Exception, match="Unknown speaker ben"):
        files.with_speakers(recipe, params.where("speaker = 'anna'")).collect()


def test_audio_and_features(spark, tmp_path):
    x = (np.sin(np.arange(8000) / 7) * 9000).astype("<i2")
    p = str(tmp_path / "a.wav")
    with wave.open(p, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(x.tobytes())
    rows = files.read_audio(spark, p).orderBy("frame").collect()
    assert len(rows) == int((8000 - 256 - 1) / 128) + 1 and len(rows[0].x) == 256
    y = x.astype(float)
    np.testing.assert_allclose(rows[3].x, y[3 * 128 + 1 : 3 * 128 + 257] - 0.97 * y[3 * 128 : 3 * 128 + 256])
    raw = files.read_audio(spark, write(tmp_path / "raw", x.astype(">i2").tobytes()), 16000, big_endian=True)
    assert [r.x for r in raw.orderBy("frame").collect()] == [r.x for r in rows]
    v = np.arange(12, dtype="<f4").reshape(4, 3)
    got = files.read_features(spark, write(tmp_path / "f", struct.pack("<i", 3) + v.tobytes())).orderBy("frame").collect()
    assert [r.x for r in got] == v.tolist() and got[0].n == 4
    assert files.read_features(spark, write(tmp_path / "g", bytes([3]) + v.tobytes()), short_header=True).count() == 4
    frames = got and spark.createDataFrame([(r.file, r.frame, r.x) for r in got], "utt string, frame int, x array<double>")
    assert [r.frame for r in files.dump_frames(frames, 1, 3, backward=True).collect()] == [3, 2, 1]
    noisy = files.dump_frames(frames, 0, 3, noise=0.1, dim=3).collect()
    assert 0 < np.abs(np.array([r.x for r in noisy]) - v).max() < 1
    files.write_states(frames.withColumn("state", F.col("frame") % 2), str(tmp_path / "states"))
    assert len(list((tmp_path / "states").glob("state=*"))) == 2


def test_likelihoods(spark, tmp_path):
    lp = -np.abs(np.random.default_rng(0).normal(size=(6, 4))) * 5
    lp[2, 1] = -50
    got = files.read_likelihoods(spark, write(tmp_path / "l", files.likelihood_bytes(lp))).orderBy("frame").collect()
    assert np.abs(np.array([r.logp for r in got]) - np.maximum(lp, -65535 / 1820)).max() < 1 / 1820
    codes = spark.createDataFrame([(float(v),) for v in lp.ravel()], "lp double").select("lp", scalars.lna_encode(F.col("lp")).alias("c"))
    assert {r.c for r in codes.where("lp < -40").collect()} == {65535}


def test_models(spark, tmp_path):
    rows = [(1, "", "<s>", -99.0, 0.0), (1, "", "a", -1.0, -0.5), (1, "", "b", -2.0, 0.0), (2, "a", "b", -0.3, 0.0)]
    got = files.read_arpa(spark, write(tmp_path / "m", files.arpa_text(rows))).collect()
    assert sorted((r.n, r.context, r.word, r.lp, r.bo) for r in got) == sorted(rows)
    with pytest.raises(Exception, match="header"):
        files.read_arpa(spark, write(tmp_path / "n", files.arpa_text(rows).replace("ngram 1=3", "ngram 1=4"))).collect()
    g = [(0, "diag", [1.0, 2.0], [0.5, 0.25]), (1, "diag", [3.0, 4.0], [1.0, 1.5])]
    assert [tuple(r) for r in files.read_gaussians(spark, write(tmp_path / "gk", files.gaussian_text(g, 2))).orderBy("gid").collect()] == g
    mixed = [g[0], (1, "full", [3.0, 4.0], [1.0, 0.1, 0.1, 1.5])]
    assert [tuple(r) for r in files.read_gaussians(spark, write(tmp_path / "gv", files.gaussian_text(mixed, 2))).orderBy("gid").collect()] == mixed
    m = files.read_mixtures(spark, write(tmp_path / "mc", "2\n2 0 0.25 1 0.75\n1 1 1.0\n")).collect()
    assert sorted(map(tuple, m)) == [(0, 0, 0.25), (0, 1, 0.75), (1, 1, 1.0)]


def test_lexicon_lattice_network(spark, tmp_path):
    lex = files.read_lexicon(spark, write(tmp_path / "x", "one(0.5) w a n\ntwo t u\nbad(1) q\n"))
    assert sorted((r.word, r.prob, r.units) for r in lex.collect()) == [("bad", 1.0, ["q"]), ("one", 0.5, ["w", "a", "n"]), ("two", 1.0, ["t", "u"])]
    units = spark.createDataFrame([(u,) for u in "wantu"], "unit string")
    assert {r.word for r in files.known_words(lex, units).collect()} == {"one", "two"}
    text = "N=3 L=2\nI=0 t=0\nJ=0 S=0 E=1 W=hi a=-1.5 l=-0.5\nJ=1 S=1 E=2 W=you a=-2\n"
    arcs = files.read_lattice(spark, write(tmp_path / "slf", text))
    assert [tuple(r)[1:] for r in arcs.orderBy("arc").collect()] == [(0, 0, 1, "hi", -1.5, -0.5), (1, 1, 2, "you", -2.0, 0.0)]
    lines = "\n".join(r.value for r in files.lattice_lines(arcs).collect())
    assert files.read_lattice(spark, write(tmp_path / "slf2", lines)).drop("file").collect() == arcs.drop("file").collect()
    net = files.read_network(spark, write(tmp_path / "net", "#FSTBasic MaxPlus\nI 0\nF 2\nT 0 1 5 x 0.5\nT 1 2\n")).collect()
    assert [(r.kind, r.src, r.dst, r.input, r.output, r.score) for r in net] == [("I", 0, None, None, None, 0.0), ("F", 2, None, None, None, 0.0), ("T", 0, 1, "5", "x", 0.5), ("T", 1, 2, None, None, 0.0)]
    pdfs = spark.createDataFrame([(1, 4), (1, 4), (2, 3)], "dst int, pdf int")
    assert sorted(map(tuple, files.pdf_by_node(pdfs).collect())) == [(1, 4), (2, 3)]
    with pytest.raises(Exception, match="conflicting"):
        files.pdf_by_node(spark.createDataFrame([(1, 4), (1, 5)], "dst int, pdf int")).collect()


def wait_for(spark, table: str, rows: int) -> None:
    """Until a stream's table has its rows: a query whose state can time out goes on without data."""
    end = time.time() + 120
    while time.time() < end and spark.table(table).count() < rows:
        time.sleep(0.5)


def test_streaming_delta_equals_batch(spark, tmp_path):
    """Frames out of order, in several batches, of utterances of all lengths."""
    rng = np.random.default_rng(5)
    rows = [(u, f, float(rng.normal()), f == n - 1) for u, n in enumerate((1, 2, 5, 30)) for f in range(n)]
    order = rng.permutation(len(rows))
    schema = "utt long, frame int, value double, closed boolean"
    folder = tmp_path / "in"
    for i in range(0, len(rows), 10):
        spark.createDataFrame([rows[j] for j in order[i : i + 10]], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = streaming_delta(stream).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        wait_for(spark, "deltas", len(rows))
        got = {(r.utt, r.frame): r.delta for r in spark.table("deltas").collect()}
    finally:
        q.stop()
    utts: dict = {}
    for u, _, v, _ in rows:
        utts.setdefault(u, []).append(v)
    true = {(u, t): sum(k * (v[min(t + k, len(v) - 1)] - v[max(t - k, 0)]) for k in (1, 2)) / 10 for u, v in utts.items() for t in range(len(v))}
    assert got == pytest.approx(true)


def test_a_bad_pronunciation_takes_no_other_with_it(spark):
    lexicon = spark.createDataFrame([("one", 0.5, ["w", "a", "n"]), ("one", 0.5, ["w", "q", "n"]), ("two", 1.0, ["q"])], "word string, prob double, units array<string>")
    units = spark.createDataFrame([("w",), ("a",), ("n",)], "unit string")
    assert [(r.word, r.units) for r in files.known_words(lexicon, units).collect()] == [("one", ["w", "a", "n"])]


def test_lattice_files_are_checked(spark, tmp_path):
    head = "VERSION=1.0\nlmscale=1.00\nwdpenalty=0.00\n"
    body = "N=2 L=1\nI=0 t=0.00\nI=1 t=0.00\nJ=0 S=0 E=1 W=hi v=0 a=0.00 l=0.000\n"
    good = files.read_lattices(spark, write(tmp_path / "good", head + body), grammar=True).collect()
    assert [tuple(r)[1:] for r in good] == [(2, 0, 0, 1, "hi", 0.0, 0.0)]
    for name, text, grammar, message in (
        ("version", head.replace("1.0\n", "2.0\n", 1) + body, True, "version 1.0"),
        ("scores", head + body.replace("a=0.00", "a=-1.5"), True, "without scores"),
        ("count", head + body.replace("L=1", "L=2"), False, "declared"),
        ("node", head + body.replace("E=1", "E=7"), False, "unknown node"),
    ):
        with pytest.raises(Exception, match=message):
            files.read_lattices(spark, write(tmp_path / name, text), grammar).collect()


def test_models_and_durations(spark, tmp_path):
    text = "PHONE\n1\n1 4 a-b+c\n-1 -2 7 8\n0 1 2 1.0\n1 0\n2 2 2 0.6 3 0.4\n3 2 3 0.5 1 0.5\n"
    rows = [tuple(r)[1:] for r in files.read_hmms(spark, write(tmp_path / "ph", text)).collect()]
    assert rows == [(1, "a-b+c", 0, -1, 2, 1.0), (1, "a-b+c", 2, 7, 2, 0.6), (1, "a-b+c", 2, 7, 3, 0.4), (1, "a-b+c", 3, 8, 3, 0.5), (1, "a-b+c", 3, 8, 1, 0.5)]
    again = [r[1:] for r in files.parse_hmms("", files.hmm_text(rows).encode())]
    assert sorted(again) == sorted(rows)
    with pytest.raises(Exception, match="invalid transition"):
        files.read_hmms(spark, write(tmp_path / "bad", text.replace("3 0.4", "9 0.4"))).collect()
    d = files.read_durations(spark, write(tmp_path / "d4", "4\n2\n0 0 0\n1 2.5 0.75\n")).collect()
    assert [tuple(r)[1:] for r in d] == [(0, 0.0, 0.0), (1, 2.5, 0.75)]
    assert files.read_durations(spark, write(tmp_path / "d3", "3\n1\n0 0 0\n1 2.5 0.75\n")).count() == 2
    m = [(0, 0, 0.25), (0, 1, 0.75), (1, 1, 1.0)]
    back = files.read_mixtures(spark, write(tmp_path / "mc", files.mixture_text(m))).collect()
    assert sorted(map(tuple, back)) == m


def test_short_audio_has_no_windows():
    for n in (0, 3, 4, 256):
        assert len(files.windows_of(np.zeros(n), 16000)) == 0
    assert files.windows_of(np.zeros(257), 16000).shape == (1, 256)


@pytest.mark.parametrize("kind", sorted(WINDOWS))
def test_streaming_windows_equal_batch_ones(spark, tmp_path, kind):
    """Vectors of two elements; the utterance that is never closed gives what its frames allow."""
    rng = np.random.default_rng(6)
    rows = [(u, f, rng.normal(size=2).tolist(), f == n - 1 and u < 2) for u, n in enumerate((3, 12, 9)) for f in range(n)]
    order = rng.permutation(len(rows))
    schema = "utt long, frame int, x array<double>, closed boolean"
    for i in range(0, len(rows), 8):
        spark.createDataFrame([rows[j] for j in order[i : i + 8]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"windows_{kind}"
    q = streaming_features(stream, kind, 2).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        wait_for(spark, name, len(rows) - 2)
        got = {(r.utt, r.frame): np.array(r.x) for r in spark.table(name).collect()}
    finally:
        q.stop()
    utts: dict = {}
    for u, _, x, _ in rows:
        utts.setdefault(u, []).append(x)
    assert set(got) == {(u, t) for u, x in utts.items() for t in range(len(x) - (2 if u == 2 else 0))}
    for (u, t), y in got.items():
        x = np.array(utts[u])
        near = x[np.clip(np.arange(t - 2, t + 3), 0, len(x) - 1)]
        true = {"delta": (np.arange(-2, 3)[:, None] * near).sum(0) / 10, "mean_subtractor": x[t] - near.mean(0), "concat": near.ravel()}[kind]
        np.testing.assert_allclose(y, true, atol=1e-12)
