"""Every query of the engine: against SQL where there is some, else that it runs."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from cadenza.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    if name in catalogue.ORACLE_SQL:
        true = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(true.columns)
        assert rows(found) == rows(true)
    else:
        assert len(found)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "places"), [("lda", "j"), ("pca", "j"), ("mllt", "j"), ("cmllr", None), ("feat_vtln_all_pass", "i")])
def test_whole_vectors_are_used(spark, name, places):
    found = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    if places:
        assert found[places].nunique() == 64
    else:
        assert len(found) == 5 * 64 * 65
    assert np.isfinite(found.select_dtypes("float").to_numpy()).all()


def test_whole_utterances_are_searched(spark, duck):
    sizes = dict(duck.sql("SELECT user_id, count(*) FROM events GROUP BY user_id").fetchall())
    words = catalogue.QUERIES["decode_words"](spark, str(SF)).toPandas()
    assert words["words"].str.split().str.len().max() > 12
    # each frame takes an acoustic score of -0.1 and an arc of -0.5 at least
    paths = catalogue.QUERIES["net_search"](spark, str(SF)).toPandas()
    assert all(r.score <= -0.6 * sizes[r.utt] + 1e-6 for r in paths.itertuples())
    events = duck.sql("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events").df().sort_values(["user_id", "n"])
    runs = events.groupby("user_id")["event_type"].apply(lambda x: (x != x.shift()).sum())
    aligned = catalogue.QUERIES["vit_align"](spark, str(SF)).toPandas().groupby("utt")["state"].nunique()
    assert aligned.to_dict() == runs.to_dict()
