"""Operators on texts: tokens, language, toxicity, fingerprints, mixing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, langid, lengths, mix, pfor, pretokens, simhash, toxicity
from cadenza.llm.shared import Scratch

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, fp int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts() -> list[str | None]:
    rng = random.Random(3)
    letters = " \n\t'sstrevmld!?a1.,éß漢😀  \x1c\u0085"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma's", "12", "don't", "<|endoftext|>"]) for _ in range(20_000))
    return [*out, None, "", " ", "\n\n", "a" * 5000, long, "<|endoftext|>", "x<|endoftext|> y", "<|endoftext", long]


def docs(spark, rows=None):
    """Documents with columns whose names clash with those of results."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", f"s{i % 3}", 0, 9.0, "x", 1) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_classes_agree_with_the_library(tokenizer):
    """Every code point splits as the library splits it."""
    table = pretokens.classes()
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p % 3 == 0 or p < 0x3100]
    text = [f"a{chr(p)}1{chr(p)}!{chr(p)}" for p in points]
    encoder = bpe.BpeModel(bpe.read_model(PATH)).encoder()
    step = 20_000
    for i in range(0, len(text), step):
        part = text[i : i + step]
        ids, at = encoder(pa.array(part))
        found = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        wrong = [hex(points[i + k]) for k, ids_ in enumerate(found) if ids[at[k] : at[k + 1]].tolist() != ids_]
        assert not wrong, wrong[:10]
    assert table[ord("a")] == pretokens.LETTER


def test_bpe_equals_the_library(spark, tokenizer):
    rows = texts()
    out = bpe.encode_and_decode(docs(spark), PATH, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = tokenizer.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_and_decode(docs(spark, []), PATH).count() == 0


def test_compatible_pairs_are_those_that_bpe_leaves_apart():
    model = bpe.BpeModel(bpe.read_model(PATH))
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    words = [i for i, b in model.bytes.items() if b.isalpha() and i not in model.special.values()]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        ids = tokenizer.encode((model.bytes[a] + model.bytes[b]).decode(), add_special_tokens=False).ids
        assert model.compatible(a, b) == (ids == [a, b])


def test_pages_round_trip(spark, tokenizer, tmp_path):
    rows = texts()
    frame = docs(spark).union(spark.createDataFrame([(None, "null id", "en", "s", 0, 0.0, "", 0), (5, "again", "en", "s", 0, 0.0, "", 0)], SCHEMA))
    pfor.write_ids(frame.repartition(5), str(tmp_path / "ids"), PATH)
    out = sorted(pfor.read_documents(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in out]
    assert ids[0] is None and ids[1:] == sorted([*range(len(rows)), 5])
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        if r.doc_id not in (None, 5):
            true = [*tokenizer.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 0]
            assert r.ids == true and r.ids_crc32 == zlib.crc32(np.array(true, "<u4").tobytes())
    pfor.write_ids(docs(spark, []), str(tmp_path / "none"), PATH)
    assert pfor.read_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("values", [[0], [7] * 3000, [2**32 - 1, 0], list(range(5000)), [5] * 1500 + [2**31] * 20])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    page = pfor.pack_page(ids, np.array([len(ids)]))
    back, sizes = pfor.unpack_page(page)
    assert back.tolist() == values and sizes.tolist() == [len(values)]
    n = len(values)
    for start in {0, n // 3, n - 1}:
        assert pfor.read_ids(page, start, min(1200, n - start)).tolist() == values[start : start + 1200]


def test_length_histogram(spark, tokenizer):
    rows = texts()
    n = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in rows)
    hist = lengths.length_histogram(lengths.token_counts(docs(spark), PATH)).cache()
    for r in hist.collect():
        assert r.n_docs == n.count(r.n_tokens)
        assert r.docs_within == sum(x <= r.n_tokens for x in n) and r.docs_beyond == sum(x > r.n_tokens for x in n)
        assert r.tokens_within == sum(x for x in n if x <= r.n_tokens) and r.tokens_beyond == sum(x for x in n if x > r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert r.quantile == pytest.approx(r.docs_within / len(n))
    assert hist.agg(lengths.truncated_total(hist, 13)).first()[0] == sum(min(x, 13) for x in n)
    assert hist.agg(lengths.quantile_length(hist, 0.5)).first()[0] == n[(len(n) + 1) // 2 - 1]
    assert lengths.length_histogram(lengths.token_counts(docs(spark, []), PATH)).count() == 0


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links: np.ndarray) -> np.ndarray:
    label = np.arange(len(links))
    while True:
        new = np.where(links, label[None], len(links)).min(1)
        new = np.minimum(new, label)
        if np.array_equal(new, label):
            return label
        label = new


def test_simhash_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows: list[str | None] = [*texts()[:40], None, "", "  ", "One two", "one  TWO"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        rows += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows.append(" ".join(rng.choice(vocabulary) for _ in range(150_000)))
    out = simhash.near_duplicates(docs(spark, rows)).orderBy("doc_id").collect()
    fps = np.array([fingerprint(t) for t in rows[:-1]], np.uint64)
    assert [r.fingerprint for r in out[:-1]] == [f"{x:016x}" for x in fps.tolist()]
    fps = np.array([int(r.fingerprint, 16) for r in out], np.uint64)
    label = components(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    assert [r.component_id for r in out] == label.tolist()
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist()))


def test_vantage_point_shards_lose_no_link(monkeypatch, spark):
    """Many small shards and cuts: components as by brute force."""
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "CELLS", 2000)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (700, 3)).astype(np.uint64)).sum(1, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips, base[:200] ^ (flips[:200] << np.uint64(1))]))
    frame = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "fp long, id long")
    scratch = Scratch(spark, "test")
    found = {r.id: r.component_id for r in simhash.connected_components(simhash.fingerprint_links(frame), scratch).collect()}
    label = components(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    signed = fps.view(np.int64)
    for c in np.unique(label):
        members = signed[label == c]
        names = {found.get(int(m), int(m)) for m in members}
        assert len(names) == 1 and names.pop() == int(members.min())


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c d e", "en", "s", 0, 0.0, "", 0), (7, "a b c d e", "en", "s", 0, 0.0, "", 0), (7, "a b c d e", "en", "s", 0, 0.0, "", 0), (None, "q r s t u v", "en", "s", 0, 0.0, "", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(7, 7): 2, (None, 7): 1, (None, None): 1})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).count() == 2


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    """Null and repeated ids: groups that share an id are groups all the same."""
    a, b, c = "a b c d e f", "q r s t u v", "k l m n o p"
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", 0, 0.0, "", 0) for i, t in x], SCHEMA)
    kept = lambda *x: sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(rows(*x)).collect())
    assert kept((None, a), (None, b), (None, c), (None, a)) == [(0, a), (0, c), (0, b)]
    assert kept((1, a), (1, b)) == [(1, a), (1, b)]
    assert kept((5, a), (5, b), (3, b)) == [(3, b), (5, a)]


def test_language_of_held_out_documents(spark):
    rng = random.Random(4)
    stems = {"aa": ["bara", "tiko", "melu", "sano"], "bb": ["drix", "vlop", "grenz", "kumpf"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice("aeiou") for _ in range(30)), lang, "s", 0, 0.0, "", 0) for i in range(200) for lang in [["aa", "bb"][i % 2]]]
    rows += [(None, "tikoa sanoe", None, "s", 0, 0.0, "", 0), (900, None, "aa", "s", 0, 0.0, "", 0), (901, "", None, "s", 0, 0.0, "", 0), (902, "12 !? 漢", None, "s", 0, 0.0, "", 0), (903, "12 !?", "bb", "s", 0, 0.0, "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = langid.learn(frame)
    assert list(found) == ["aa", "bb"]
    out = {r.doc_id: r for r in langid.identify(frame, found).collect()}
    assert all(out[i].lang_pred == ["aa", "bb"][i % 2] and out[i].accepted for i in range(200))
    assert [out[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and out[900].score == 0
    assert out[902].lang_pred in found and 0 <= out[902].score <= 1
    empty = frame.limit(0)
    assert langid.learn(empty) == {} and langid.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in langid.identify(frame, {}).collect()} == {"und"}
    kept = langid.identify(frame, found, keep=True)
    assert kept.columns == frame.columns and kept.where("doc_id < 200").count() == 200 and kept.where("doc_id in (900, 901, 903)").count() == 0


def test_ties_of_two_languages_are_rejected(spark):
    rng = random.Random(4)
    stems = {"aa": ["bara", "tiko", "melu", "sano"], "bb": ["drix", "vlop", "grenz", "kumpf"], "cc": ["huwy", "juqe", "yaxi", "woqu"]}
    text = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice("aeiou") for _ in range(n))
    found = {lang: "\n".join(text(lang, 30) for _ in range(100)).encode() for lang in stems}
    rows = [(1, "漢字漢字", None), (2, text("aa", 6), None), (3, text("bb", 30), None), (4, text("cc", 12), None)]
    frame = spark.createDataFrame([(i, t, lang, "s", 0, 0.0, "", 0) for i, t, lang in rows], SCHEMA)
    for known in (("aa", "bb"), ("aa", "bb", "cc")):
        out = {r.doc_id: r for r in langid.identify(frame, {k: found[k] for k in known}).collect()}
        assert not out[1].accepted
        assert [out[i].lang_pred for i in (2, 3)] == ["aa", "bb"] and out[2].accepted and out[3].accepted
    assert out[4].lang_pred == "cc" and out[4].accepted
    twice = langid.identify(frame, {"aa": found["aa"], "ab": found["aa"], "bb": found["bb"]})
    assert {r.doc_id: r.accepted for r in twice.collect()}[2] is False
    one = langid.identify(frame, {"aa": found["aa"]}, keep=True)
    assert one.where("doc_id = 2").count() == 1


def test_chain_is_the_forward_backward_recursion():
    import itertools

    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    for n in (1, 6, 10):
        score, first = rng.normal(size=n) * 4, rng.random(n) < 0.3
        first[0] = True
        forward, backward = field.ratios(score, first)
        total, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[t] * y[t] + (field.start[y[t]] if first[t] else field.transition[y[t - 1], y[t]]) for t in range(n)))
            total, mass = total + w, mass + w * np.array(y)
        np.testing.assert_allclose(forward * backward / (1 + forward * backward), mass / total, atol=1e-9)


def test_toxic_documents_and_spans(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("lor", "bem", "ti") for b in ("an", "os", "ir") for c in ("ta", "de", "mu", "né")]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randint(0, len(text)), "zlobr" + rng.choice("aeiouxyz"))
        rows.append((i, " ".join(text).capitalize(), "en", "s", 0, 0.0, "", 0))
        labels.append((i, int(toxic), 1))
    rows += [(None, "zlobra Zlobri.", "en", "s", 0, 0.0, "", 0), (5000, None, None, None, 0, 0.0, "", 0), (5001, "", None, None, 0, 0.0, "", 0), (5002, "é, zlobrq lorosta", None, None, 0, 0.0, "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (99999, 1, 1)], "doc_id long, toxic int, text int")
    field = toxicity.learn(frame, marks)
    out = {r.doc_id: r for r in toxicity.tag(frame, field).collect()}
    wrong = [i for i in range(900) if out[i].predicted != (i % 4 == 0)]
    assert len(wrong) <= 9
    assert out[None].predicted == 1 and out[5000].predicted == 0 == out[5001].predicted and out[5000].spans == []
    assert [(s.start, s.end) for s in out[5002].spans] == [(3, 9)]
    kept = toxicity.tag(frame, field, keep=True)
    assert kept.columns == frame.columns and kept.count() == sum(1 - r.predicted for r in out.values())
    assert {r.score for r in toxicity.tag(frame, None).collect()} == {0.0}
    assert toxicity.learn(frame.limit(0), marks.limit(0)) is None


def water_fill(sizes: dict, weights: dict) -> dict:
    """Targets by resharing the excess again and again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = float(sum(sizes.values())), [s for s in sizes if sizes[s]]
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        full = [s for s in open_ if target[s] >= 3 * sizes[s]]
        for s in full:
            target[s] = 3.0 * sizes[s]
        open_ = [s for s in open_ if s not in full]
    return target


def test_mix_takes_each_budget(spark, monkeypatch):
    monkeypatch.setattr(mix, "RANGE_ROWS", 20)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) if i % 17 else None, None, None if i % 11 == 0 else rng.choice(["a", "b", "c", "c", "c", "c", "é"]), 0, 0.0, "", 0) for i in range(800)]
    rows += [(None, "x y z", None, "b", 0, 0.0, "", 0), (5, "x y", None, "b", 0, 0.0, "", 0), (5, "x y", None, "b", 0, 0.0, "", 0), (6000, "", None, "empty", 0, 0.0, "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    sized = mix.size_documents(frame, Scratch(spark, "test"))
    out = mix.mix(sized).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = water_fill(dict(sizes), weights)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    assert sorted(map(str, out)) == sorted(map(str, mix.mix(sized).collect()))
    assert mix.mix(sized.limit(0)).count() == 0
    mixed = mix.mixed_documents(frame)
    assert mixed.columns == frame.columns and mixed.count() > 0
    words = mixed.groupBy("source").agg(F.sum(mix.word_count(F.col("text"))).alias("n")).collect()
    assert all(abs(r.n - target[r.source]) <= 60 for r in words)
