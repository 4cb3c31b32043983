"""The registered queries against SQL, and the pipeline against its stages' meaning."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cadenza.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, true = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(true.columns)
    at = [true.columns.index(c) for c in found.columns]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in true.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    first, sizes = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(SF))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
        sizes.append(docs.count())
    assert 0.9 * first.count() <= sizes[0] <= first.count() and sizes[1] <= sizes[0] and sizes[2] <= sizes[1]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sizes[4] == sizes[3] > 0
    whole = corpus_pipeline.run(spark, str(SF))
    assert sorted(whole.collect()) == sorted(docs.collect())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows recomputed in plain Python from the rows of the stage before."""
    import hashlib
    from collections import Counter

    import numpy as np
    import regex
    import zstandard
    from test_texts import components, fingerprint, water_fill
    from tokenizers import Tokenizer

    import corpus_pipeline
    from cadenza.llm import langid, toxicity

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    tables, frames = [docs.collect()], [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs.collect())
        frames.append(docs)
    rows = lambda table: Counter((r.doc_id, r.text) for r in table)
    # compressed sizes decide the language
    known = langid.learn(frames[0])
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in known.values()]

    def clear(text: str | None) -> bool:
        if text is None or not regex.search(r"\p{L}", text):
            return False
        sizes = np.sort([float(len(c.compress(text.lower().encode()))) for c in coders])
        return 1 / np.exp((sizes[0] - sizes) / langid.SCALE).sum() >= langid.ACCEPTED and sizes[1] - sizes[0] >= langid.LEAST_GAP

    assert rows(tables[1]) == Counter((r.doc_id, r.text) for r in tables[0] if clear(r.text))
    # one document at a time through the field, by its recursion as it stands
    field = toxicity.learn(frames[1], spark.read.parquet(str(SF / "labels.parquet")))
    log = lambda x: np.log(np.maximum(x, 1e-300))

    def clean(text: str) -> bool:
        import pyarrow as pa

        data, offsets = toxicity.text_bytes(pa.array([text]))
        small = toxicity.lower(data)
        begin, close, _ = toxicity.find_words(small, offsets)
        first = np.arange(len(begin)) == 0
        score = np.clip(field.weights[toxicity.features(small, begin, close, first)].sum(0), -30, 30)
        n = len(begin)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            emit = np.array([0.0, score[t]])
            forward[t] = emit + (field.start if t == 0 else np.logaddexp(forward[t - 1, 0] + field.transition[0], forward[t - 1, 1] + field.transition[1]))
        for t in range(n - 2, -1, -1):
            after = backward[t + 1] + np.array([0.0, score[t + 1]])
            backward[t] = np.logaddexp(field.transition[:, 0] + after[0], field.transition[:, 1] + after[1])
        both = forward + backward
        p = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])) if n else np.zeros(0)
        top = np.clip(p.max(initial=0), 6e-6, 1 - 6e-6)
        summary = np.array([log(top / (1 - top)) if n else -12.0, np.log1p(p[p > 0.1].sum()), 1.0])
        return 1 / (1 + np.exp(-np.clip(summary @ field.logistic, -30, 30))) < toxicity.TOXIC

    assert rows(tables[2]) == Counter((r.doc_id, r.text) for r in tables[1] if clean(r.text))
    # all pairs of fingerprints
    given = sorted(tables[2], key=lambda r: r.doc_id)
    prints = np.array([fingerprint(r.text) for r in given], np.uint64)
    label = components(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    assert sorted(r.doc_id for r in tables[3]) == sorted(given[i].doc_id for i in set(label.tolist()))
    # words of each source against its target
    size = lambda r: len(regex.findall(r"[^\x20\x09-\x0D]+", r.text))
    sizes, largest, taken = Counter(), {}, Counter()
    for r in tables[3]:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest.get(r.source, 0), size(r))
    for r in tables[4]:
        taken[r.source] += size(r)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = water_fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert set(rows(tables[4])) <= set(rows(tables[3])) and max(rows(tables[4]).values()) <= 4
    # ids of the library
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()

    def coded(r) -> tuple:
        ids = library.encode(r.text, add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())

    assert Counter(map(tuple, tables[5])) == Counter(map(coded, tables[4]))
