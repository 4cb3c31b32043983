"""Nulls, repeats, ties, empty tables and clashing columns for all operators and all stages of the pipeline."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import bpe, chat, kdtopk, langid, lengths, licenses, merkle, mix, pfor, simhash, toxicity, vecgraph
from cadenza.llm.components import connected_components
from cadenza.llm import components
from cadenza.llm.shared import Scratch, drop_scratch, passing_scratch

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
#: Names that operators use inside, or return.
CLASHING = ("n", "_n", "_doc_id", "_lang", "_kept", "_place", "_unit", "_times", "_copy", "row", "fp", "root", "score", "predicted", "size", "unit", "range", "before", "key", "target", "start", "item", "a", "b", "part", "block", "h", "leaf", "tree", "idx", "hash", "path", "line", "words", "small", "places", "good", "same")
DOCS = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING)


def rows_of(n: int = 60) -> list[tuple]:
    rng = random.Random(3)
    words = {"en": ["the", "house", "green", "river"], "de": ["das", "haus", "gruen", "fluss"]}
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        out.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(30)), lang, ("x", "y", None)[i % 3]))
    out += [out[0], out[0], (None, "the houses green", "en", "x"), (None, None, None, None), (5, None, "en", "y"), (5, "", None, "x"), (None, "   ", "de", None), (7, "w " * 30_000, "en", "z")]
    return out


def docs(spark, rows):
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` long" for c in CLASHING))


def turns(spark, rows):
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` long" for c in CLASHING))


OPERATORS = {
    "mix": lambda spark, d, folder: mix.mix(mix.size_documents(d, Scratch(spark, "test"))),
    "toxicity": lambda spark, d, folder: toxicity.tag(d, toxicity.learn(d, d.select("doc_id", F.expr("cast(doc_id % 2 as int)").alias("toxic"), F.lit(1).alias("_doc_id")))),
    "simhash": lambda spark, d, folder: simhash.near_duplicates(d),
    "lengths": lambda spark, d, folder: lengths.token_counts(d, PATH),
    "bpe": lambda spark, d, folder: bpe.encode_and_decode(d, PATH),
    "langid": lambda spark, d, folder: langid.identify(d, langid.learn(d)),
    "merkle": lambda spark, d, folder: merkle.proofs(merkle.manifest(d.withColumn("n_chars", F.length("text")), merkle.lower_ascii(F.col("text")))),
    "licenses": lambda spark, d, folder: licenses.summarize(licenses.scan(d)),
    "pfor": lambda spark, d, folder: (pfor.write_ids(d, folder, PATH), pfor.read_documents(spark, folder))[1],
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_text_operators_take_odd_tables(spark, tmp_path, name):
    rows = rows_of()
    out = OPERATORS[name](spark, docs(spark, rows), str(tmp_path / "ids")).collect()
    assert len(out) == len(rows)
    assert len(OPERATORS[name](spark, docs(spark, []), str(tmp_path / "none")).collect()) == 0
    nulls = [(None, None, None, None)] * 3
    assert len(OPERATORS[name](spark, docs(spark, nulls), str(tmp_path / "nulls")).collect()) == 3


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_tables(spark, tmp_path, k):
    rows = rows_of()
    spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, [], [(None, None, None, None)] * 3):
        frame = docs(spark, given)
        out = corpus_pipeline.STAGES[k][1](spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        found = out.collect()
        # values of other columns are as they were
        assert all(tuple(r)[4:] == tuple(range(len(CLASHING))) for r in found)
        texts = {r[1] for r in given}
        assert {r.text for r in found} <= texts
        if not given:
            assert not found
    assert len(corpus_pipeline.STAGES[4][1](spark, docs(spark, rows), str(tmp_path)).collect()) == len(rows)


def test_mix_takes_rows_of_a_repeated_id_for_themselves(spark):
    """Rows of one doc_id in two sources: each source meets its own target."""
    rows = [(1, f"a{i} b c d", None, "a") for i in range(30)] + [(1, f"z{i} y", None, "b") for i in range(200)]
    out = mix.mixed_documents(docs(spark, rows)).groupBy("source").agg(F.sum(mix.word_count(F.col("text"))).alias("n")).collect()
    target = {r.source: r.target for r in mix.mix(mix.size_documents(docs(spark, rows), Scratch(spark, "test"))).select("source", "target").distinct().collect()}
    assert all(abs(r.n - target[r.source]) <= 2 for r in out) and len(out) == 2


def test_vector_operators_take_odd_tables(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (None, [1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (40, [0.0, 0.0])]
    assert len(vecgraph.near_vectors(vectors(spark, rows)).collect()) == len(rows)
    out = kdtopk.top_k(vectors(spark, rows)).collect()
    assert {r.query_id for r in out} == {20, 40}
    for n in (0, 3):
        empty = vectors(spark, [(None, None)] * n)
        assert vecgraph.near_vectors(empty).count() == n and kdtopk.top_k(empty).count() == 0


def test_chats_whose_turns_say_nothing(spark):
    """Turns that are null, equal or far apart, in one conversation that holds most rows."""
    hot = [(1, None, "user", f"t{i:04d}") for i in range(400)] + [(1, 7, "user", f"u{i:04d}") for i in range(400)] + [(1, 10**15 * i, "user", "v") for i in range(1, 200)]
    rows = [*hot, *((2, *r[1:]) for r in hot[:300]), (None, 1, None, None), (None, 1, None, ""), (3, 1, "user", "v"), (3, 1, "user", "v"), (4, 1, "user", "v")]
    out = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(out) == {1, None, 3}
    assert out[1][0] == len(hot)
    want = "".join(f"<|im_start|>{r[2]}\n{r[3]}<|im_end|>\n" for r in sorted(hot, key=lambda r: (r[1] is not None, r[1] or 0, r[3])))
    assert out[1][1] == want
    assert out[3] == (2, "<|im_start|>user\nv<|im_end|>\n" * 2)
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_documents_of_any_length_teach_toxicity(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("lor", "bem", "tis", "kun") for b in ("anta", "osde", "irmu")]
    rows, labels = [], []
    for i in range(200):
        text = [rng.choice(words) for _ in range(700)]
        if i % 2:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), "zlobr" + rng.choice("aeiou"))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, i % 2))
    assert min(len(r[1]) for r in rows) > 4000
    frame = docs(spark, rows)
    field = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.tag(frame, field).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 198


def test_neighbours_find_spans_that_no_cue_names(spark):
    """A word that was never seen, between words that only stand around toxic ones, is toxic; elsewhere it is not."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("lor", "bem", "tis", "kun") for b in ("anta", "osde", "irmu")]
    before, after, curses = [f"you{c}" for c in "abcdefgh"], [f"there{c}" for c in "abcdefgh"], ["zlobra", "krifod", "mavuxe", "drohib"]
    sample = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(30)]
        for _ in range(2):
            at = rng.randrange(len(text))
            one_side = [rng.choice(before), rng.choice(words)] if rng.random() < 0.5 else [rng.choice(words), rng.choice(after)]
            text[at:at] = [rng.choice(before), rng.choice(curses), rng.choice(after)] if i % 2 else one_side
        sample.append((" ".join(text), i % 2))
    field = toxicity.fit(sample)
    frame = docs(spark, [(1, "lorosde youa qqqqq therec bemanta", "en", "s"), (2, "lorosde kunirmu qqqqq bemanta", "en", "s")])
    out = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in toxicity.tag(frame, field).collect()}
    assert out == {1: [(13, 18)], 2: []}


def test_every_labelled_language_can_be_predicted(spark, monkeypatch):
    """201 languages; sizes are those of compression with each dictionary."""
    import zstandard

    rng = random.Random(8)
    stems = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(201)}
    rows = [(i * 1000 + k, " ".join(rng.choice(s) for _ in range(20)), lang, "s") for k, (lang, s) in enumerate(stems.items()) for i in range(3)]
    frame = docs(spark, rows)
    found = langid.learn(frame)
    assert sorted(found) == sorted({r[2] for r in rows if any(q[2] == r[2] for q in rows)}) or len(found) >= 195
    out = langid.identify(frame, found).collect()
    lang = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out if lang[r.doc_id] in found]) > 0.97
    text = {r[0]: r[1] for r in rows}
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    names = sorted(found)
    for r in sorted(out)[:5]:
        raw = text[r.doc_id].lower().encode()
        sizes = []
        for name in names:
            data = zstandard.ZstdCompressionDict(found[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress(raw)))
        best = int(np.argmin(sizes))
        assert r.lang_pred == names[best]
        assert r.score == pytest.approx(1 / np.exp((sizes[best] - np.array(sizes, float)) / langid.SCALE).sum())
        assert r.accepted == (r.score >= langid.ACCEPTED and sorted(sizes)[1] - sizes[best] >= langid.LEAST_GAP)


def test_whole_documents_make_the_dictionaries_within_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "BYTES", 5000)
    rows = [(i, f"word{i} " * 150, "en", "s") for i in range(50)]
    found = langid.learn(docs(spark, rows))["en"].decode().split("\n")
    assert set(found) <= {r[1] for r in rows} and 5000 <= sum(map(len, found)) < 5000 + 1500


def test_hot_nodes_meet_their_minimum_by_a_broadcast(spark, monkeypatch):
    """The centre of a large star and a chain: the components, and no large task."""
    monkeypatch.setattr(components, "HOT_LINKS", 50)
    links = [(10_000 + i, 5) for i in range(3000)] + [(3, 10_000), (20_000, 20_001), (20_001, 20_002)]
    out = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), forest=True).collect()}
    assert all(out[a] == out[b] == 3 for a, b in links[:3001])
    assert [out[i] for i in (20_000, 20_001, 20_002)] == [20_000] * 3
    plan = components._with_least(spark.createDataFrame(links, "u long, v long"), 3000, 6006)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_special_token_of_any_length_is_one_token():
    import json

    spec = json.loads(bpe.read_model(PATH))
    token = spec["added_tokens"][0]
    spec["model"]["vocab"].pop(token["content"], None)
    token["content"] = "<stop>"
    model = bpe.BpeModel(json.dumps(spec))
    assert model.encode_word(b"<stop>") == [token["id"]] and model.encode_word(b"<stop") != [token["id"]]


def test_scratch_goes_when_its_readers_are_done(spark, tmp_path):
    import os

    frame = docs(spark, rows_of(20))
    with passing_scratch():
        simhash.keep_one(frame).write.parquet(str(tmp_path / "kept"))
        inside = [s.root.removeprefix("file:") for s in Scratch.made][-1]
        assert os.path.exists(inside)
    assert not os.path.exists(inside)
    Scratch(spark, "more").put(frame.limit(1), "x", keep=True)
    drop_scratch()
    assert Scratch.made == []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lengths.token_counts(frame, PATH).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
