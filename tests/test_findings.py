"""What findings of reviews named: work that grew faster than the input, and results that differed."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import lattice, networks, search, training
from cadenza.operators import language_model as lm
from cadenza.plans import catalogue
from cadenza.sources import files, ranged

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, name: str, folder: str) -> None:
    """The query's rows over a folder of tables are those of its SQL."""
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    true = con.sql(catalogue.ORACLE_SQL[name]).df()
    found = catalogue.QUERIES[name](spark, folder).toPandas()
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert len(true) and rows(found) == rows(true)


def test_weights_of_lattices_are_pushed_in_one_shuffle(spark):
    text = plan(catalogue.QUERIES["lm_push"](spark, SF))
    assert text.count("Exchange ") == 1 and "ExistingRDD" not in text
    arcs = [(n, i * 2 + s, i, i + s, float(-(7 * i + 3 * s + n) % 5)) for n in range(3) for i in range(1, 7 + n) for s in (1, 2) if i + s <= 7 + n]
    df = spark.createDataFrame(arcs, "net long, arc int, src int, dst int, w double")
    ours = {(r.net, r.arc): r.w for r in lattice.pushed_weights(df).collect()}
    graph = df.select((F.col("net") * 100 + F.col("src")).alias("src"), (F.col("net") * 100 + F.col("dst")).alias("dst"), "w", "net", "arc").cache()
    assert ours == {(r.net, r.arc): r.w for r in lm.push_weights(graph).collect()} and len(ours) == len(arcs)


def test_paths_of_expanded_lattices_need_no_joins(spark):
    text = plan(catalogue.QUERIES["decode_trigram"](spark, SF))
    assert "Join" not in text and text.count("Exchange ") == 2
    rows = [(0, 1, "", 2, "a", "a", -1.0), (0, 1, "", 2, "b", "b", -1.0), (0, 2, "a", 3, "x", "x", -2.0), (0, 2, "b", 3, "x", "x", -1.0), (1, 4, "", 9, "z", "z", -3.0)]
    grown = spark.createDataFrame(rows, "net long, src int, history string, dst int, dst_history string, word string, score double")
    got = [tuple(r) for r in lattice.numbered_states(grown).orderBy("net", "arc").collect()]
    assert got == [(0, 0, 0, 1, "a", -1.0), (0, 1, 0, 2, "b", -1.0), (0, 2, 1, 3, "x", -2.0), (0, 3, 2, 3, "x", -1.0), (1, 0, 0, 1, "z", -3.0)]
    assert [tuple(r) for r in lattice.best_expanded(grown).orderBy("net", "place").collect()] == [(0, 0, "b", -1.0), (0, 1, "x", -1.0), (1, 0, "z", -3.0)]


def test_tokens_are_recombined_without_sorting(monkeypatch):
    rng = np.random.default_rng(3)
    key, score, tie = rng.integers(0, 500, 4000), rng.integers(-9, 0, 4000).astype(float), rng.integers(0, 9, 4000)
    slow = search._best_of(key * 10**9, score, tie)
    monkeypatch.setattr(np, "lexsort", None)
    assert (search._best_of(key, score, tie) == slow).all()


def loud_events(tmp_path) -> str:
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 50 = 7 THEN value + 900 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["src_audio", "src_ranged", "src_last_frame"])
def test_samples_beyond_16_bits_are_kept(spark, tmp_path, name):
    against_sql(spark, name, loud_events(tmp_path))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}").write_bytes(files.wave_bytes(np.arange(i) % 50, 250))
    df = ranged.read_ranged(spark, str(tmp_path), "wav", frames=16)
    assert df.rdd.getNumPartitions() < 30
    rows = lambda df: sorted((r.file.rpartition("/")[2], r.frame, r.n, *r.x) for r in df.collect())
    assert rows(df) == rows(files.read_audio(spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["lat_hand_down", "seg_posterior", "lat_expand", "lat_rescore"])
def test_lattices_of_orders_are_dealt_once(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text


def test_values_and_posteriors_within_nets_are_those_of_joins(spark):
    arcs = [(n, i * 2 + s, i, i + s, float(-(7 * i + 3 * s + n) % 5), float(i % 4), i % 3, str(i % 2)) for n in range(3) for i in range(1, 7 + n) for s in (1, 2) if i + s <= 7 + n]
    df = spark.createDataFrame(arcs, "net long, arc int, src int, dst int, score double, value double, child int, pdf string").withColumn("frame", F.col("src"))
    scored = lattice.path_scores(df)
    total = scored.join(df.select("net", "arc", "score"), ["net", "arc"]).select("net", "arc", (F.col("forward") + F.col("backward") + F.col("score")).alias("total"))
    for how in ("avg", "sum", "max"):
        slow = lattice.handed_down(lattice.path_values(df, how).join(total, ["net", "arc"]), df.select("net", "arc", "child"), how)
        true = {(r.net, r.child): r.custom for r in slow.collect()}
        assert {(r.net, r.child): r.custom for r in lattice.values_handed_down(df, how).collect()} == pytest.approx(true)
    true = {(r.net, r.frame, r.pdf): r.posterior for r in lattice.frame_posteriors(scored, df.select("net", "arc", "frame", "pdf")).collect()}
    assert {(r.net, r.frame, r.pdf): r.posterior for r in lattice.posteriors_of_frames(df).collect()} == pytest.approx(true)


def test_modes_share_one_pass(spark):
    assert plan(catalogue.QUERIES["lat_backward_modes"](spark, SF)).count("MapInArrow") == 1


def test_arcs_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, stored = [], networks.stored
    monkeypatch.setattr(networks, "stored", lambda df: (plans.append(plan(df)), stored(df))[1])
    arcs = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") * 2 % 3000).alias("dst"))
    assert networks.reachable(arcs, F.col("src") == 1).count() == 103
    steps = [p for p in plans if "Join" in p]
    assert steps and all("BuildRight" in p and "SortMergeJoin" in p for p in steps)


def test_models_are_counted_once(spark):
    assert "conversations" not in plan(catalogue.QUERIES["lm_sum_check"](spark, SF))
    assert plan(catalogue.QUERIES["lm_trigram_interp"](spark, SF)).count("conversations") <= 2


def test_sums_of_a_batch_are_made_once(spark):
    model = training.States(np.zeros((1, 1)) + 1, np.zeros((1, 1, 1)), np.ones((1, 1, 1)), np.full(1, 0.5))
    frames = spark.createDataFrame([(0, t, [float(t)], [0] if t == 0 else None) for t in range(3)], "utt long, frame int, x array<double>, chain array<int>")
    assert "MapInArrow" not in plan(training.sums_of(frames, model))


def test_contents_are_made_row_by_row(spark):
    assert "ArrowEvalPython" not in plan(catalogue.QUERIES["src_features"](spark, SF))
