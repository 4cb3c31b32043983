"""Hot keys, bounds of samples, results that do not depend on how rows are dealt, and held-out quality on given tables."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import components

from cadenza.llm import langid, mix, queries, simhash, toxicity
from cadenza.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LARGE = "/root/testdata/sf0.1"


def test_the_kept_row_is_the_same_however_rows_are_dealt(spark):
    """Rows that agree in doc_id and text but not in source; rows that agree in all."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(20)]
    rows = [(i % 7, t, None, f"s{k}", k) for i, t in enumerate(texts) for k in range(6)] + [(None, t, "en", "s0", 0) for t in texts[:5]]
    rows += [rows[0]] * 50 + [rows[4]] * 3
    seen = set()
    for seed in range(4):
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, DOCS).repartition(1 + 3 * seed)
        kept = simhash.keep_one(frame).collect()
        assert len(kept) == len(texts)
        seen.add(tuple(sorted(map(repr, map(tuple, kept)))))
    assert len(seen) == 1
    odd = spark.createDataFrame([(1, "a b c", 2), (1, "a b c", 3)], "doc_id long, text string, `a.b` int")
    assert simhash.keep_one(odd).columns == ["doc_id", "text", "a.b"] and simhash.keep_one(odd).count() == 1


@pytest.mark.parametrize("half", [0, 1])
def test_fingerprints_with_one_half_are_split_by_the_other(spark, monkeypatch, half):
    monkeypatch.setattr(simhash, "CELLS", 3000)
    compared = []
    plain = simhash._Shard.compare
    monkeypatch.setattr(simhash._Shard, "compare", lambda self, p, q: (compared.append(len(p) * len(q)), plain(self, p, q)))
    rng = np.random.default_rng(half)
    base = rng.integers(0, 2**32, 600, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 32, (600, 3)).astype(np.uint64)).sum(1, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    fps = np.unique(np.concatenate([base, base ^ flips])) << np.uint64(0 if half else 32)
    fps |= np.uint64(0xABCD1234) << np.uint64(32 if half else 0)
    shard = simhash._Shard(fps, half)
    shard.within(np.arange(len(fps)))
    assert shard.labels.tolist() == components(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3).tolist()
    assert sum(compared) < 0.9 * len(fps) ** 2


def test_mix_of_an_id_that_most_rows_bear_equals_sql(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 else 7, " ".join("w" * rng.randrange(9)), None, rng.choice(["a", "b", None, "c"]), 0) for i in range(900)] + [(i, "x y z", None, "d", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    found = mix.mix(mix.size_documents(frame, Scratch(spark, "test")))
    true = con.sql(queries.ORACLE_SQL["op1_mix"])
    at = [true.columns.index(c) for c in found.columns]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in true.fetchall())
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "source"]


def test_units_without_an_id_are_dealt_to_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mix, "RANGE_ROWS", 50)
    rows = [(None, f"word{i} and more", None, "a", 0) for i in range(1000)]
    kept = mix.mixed_documents(spark.createDataFrame(rows, DOCS)).count()
    assert kept == 1000
    keys = spark.createDataFrame(rows, DOCS).select(F.floor(mix.random_key(F.hex(mix.digest("doc_id", "source", "text"))) / F.lit(float(1 << 60)) * 20).alias("r")).distinct()
    assert keys.count() == 20


def test_one_long_document_does_not_teach(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST", 2000)
    rows = [(i, "bara tiko melu " * 20, "aa", "s", 0) for i in range(20)] + [(100, "zz " * 5000, "aa", "s", 0), (101, "yy " * 5000, "bb", "s", 0)]
    found = langid.learn(spark.createDataFrame(rows, DOCS))
    assert set(found) == {"aa"} and b"zz" not in found["aa"]
    monkeypatch.setattr(toxicity, "LONGEST", 400)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.extend(sample))
    docs = spark.createDataFrame([(i, "w " * (100 if i % 2 else 1000), None, "s", 0) for i in range(30)], DOCS)
    toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    assert seen and all(len(t) <= 400 for t, _ in seen)


def test_held_out_languages_of_the_given_documents(spark):
    found = queries.op10_langid(spark, LARGE).where("held_out")
    true = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    n, wrong = found.join(true, "doc_id").agg(F.count(F.lit(1)), F.sum((F.col("lang") != F.col("lang_pred")).cast("int"))).first()
    assert n == 2499 and wrong <= 16


def test_held_out_toxicity_of_the_given_documents(spark):
    found = queries.op3_toxicity(spark, LARGE).where("held_out")
    rows = found.join(spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic"), "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) == 144 and sum(toxic) >= 110 and sum(clean) <= 0.01 * len(clean)


def test_small_tables_are_few_files_whatever_the_partitions(spark, monkeypatch):
    """The pipeline on check_h: each file is some six processes, which for a moment have all memory of the JVM."""
    import subprocess

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(150)]
    long = " ".join(f"v{i}" for i in range(2000))
    rows = [(i, t + " x" * (i % 2), "en", f"s{i % 3}", 0) for i, t in enumerate(texts + texts)] + [(1000 + i, f"{long} y{i}", "en", "s0", 0) for i in range(40)] + [(None, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    written, put = {}, Scratch.put

    def counting(self, df, name, keep=False):
        out = put(self, df, name, keep)
        written[name] = int(subprocess.run(f"ls {self.root.removeprefix('file:')}/{name} | grep -c ^part-", shell=True, capture_output=True, text=True).stdout)
        return out

    def results():
        kept = simhash.keep_one(docs)
        mixed = mix.mixed_documents(docs)
        groups = simhash.near_duplicates(docs)
        return [sorted(map(repr, x.collect())) for x in (kept, mixed, groups)], [x.rdd.getNumPartitions() for x in (kept, mixed)]

    want, _ = results()
    monkeypatch.setattr(Scratch, "put", counting)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, parts = results()
        assert got == want
        assert {"distinct", "links-0", "links-1", "names", "units"} <= set(written)
        assert {name: n for name, n in written.items() if name != "prints" and n != 1} == {} and parts == [1, 1]
        # larger tables keep their partitions
        monkeypatch.setattr(simhash, "PART_BYTES", 10)
        assert simhash.keep_one(docs).rdd.getNumPartitions() == 31
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
