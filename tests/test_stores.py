"""Ranged reads against readers of whole files, n-gram stores against models, and ascent of a discriminative objective."""

from __future__ import annotations

import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import discriminative
from cadenza.operators import language_model as lm
from cadenza.operators.statistics import Mixture
from cadenza.sources import files, ranged


def rows(df, value="x"):
    return {(r.file.rsplit("/", 1)[-1], r.frame): (r[value], r["n"] if value == "x" else None) for r in df.collect()}


def test_ranges_give_the_frames_of_whole_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    folder = tmp_path / "wav"
    folder.mkdir()
    for name, n, rate, channels in (("a", 16000 * 3 + 7, 16000, 1), ("b", 3000, 8000, 2), ("c", 10, 16000, 1), ("d", 40_001, 11025, 1)):
        with wave.open(str(folder / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(rng.integers(-3000, 3000, n * channels).astype("<i2").tobytes())
    whole = rows(files.read_audio(spark, str(folder)))
    df = ranged.read_ranged(spark, str(folder), "wav", frames=37)
    assert rows(df) == whole and len(whole) > 400
    # one file is many tasks' work, and no task holds more than its frames
    parts = df.where(F.col("file").endswith("/a")).select(F.spark_partition_id().alias("p"), "frame").groupBy("p").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) <= 37
    raw = tmp_path / "raw"
    raw.write_bytes(rng.integers(-3000, 3000, 30_000).astype(">i2").tobytes() + b"\x01")
    got = rows(ranged.read_ranged(spark, raw.as_uri(), "raw", frames=11, rate=16000, bigendian=True))
    samples = np.frombuffer(raw.read_bytes()[:-1], ">i2").astype(float)
    true = files.windows_of(samples, 16000)
    assert len(got) == len(true)
    for (_, f), (x, n) in got.items():
        np.testing.assert_allclose(x, true[f])
        assert n == len(true)


@pytest.mark.parametrize("short", [False, True])
def test_ranges_of_features_and_likelihoods(spark, tmp_path, short):
    rng = np.random.default_rng(1)
    folder = tmp_path / "f"
    folder.mkdir()
    for name, n in (("a", 1000), ("b", 1), ("c", 0)):
        (folder / name).write_bytes(files.feature_bytes(rng.normal(size=(n, 5)), short) + b"\x00" * (name == "b"))
    assert rows(ranged.read_ranged(spark, str(folder), "features", frames=64, shortheader=short)) == rows(files.read_features(spark, str(folder), short))
    for width in (1, 2, 4):
        path = tmp_path / f"p{width}"
        path.write_bytes(files.likelihood_bytes(-5 * rng.random((300, 7)), width))
        assert rows(ranged.read_ranged(spark, str(path), "likelihoods", frames=50), "logp") == rows(files.read_likelihoods(spark, str(path)), "logp")


def test_a_stored_model_is_not_moved(spark):
    texts = spark.createDataFrame([(i, " ".join("abcd"[(i * k) % 4] + str(k % 3) for k in range(1, 12))) for i in range(30)], "id int, text string")
    sents = lm.sentences(texts, "id", "text")
    model = lm.ngram_model([lm.count_ngrams(sents.where("id < 20"), "id", n) for n in (1, 2, 3)])
    store = lm.NgramStore.write(model, "grams_of_a_test", 6)
    grams = lm.histories(sents, "id", 3)
    for interpolated in (False, True):
        found = store.scores(grams, interpolated)
        key = lambda df: sorted((r.context, r.word, round(r.lp, 9)) for r in df.collect())
        assert key(found) == key(lm.model_scores(grams, model, 3, interpolated))
    plan = store.scores(grams)._jdf.queryExecution().executedPlan().toString()
    # what is looked up goes to the model's buckets; the model's side of the join has no exchange
    assert len(re.findall(r"Exchange hashpartitioning\(gram#\d+, 6\)", plan)) == 1 and "SortMergeJoin [gram#" in plan
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 6 out of 6" in plan
    spark.sql("DROP TABLE grams_of_a_test")


def sample(spark, n=300, dim=3):
    rng = np.random.default_rng(5)
    means = rng.normal(size=(3, dim)) * 0.8
    data = [(int(c), (means[c] + rng.normal(size=dim) * (1 + 0.5 * c)).tolist()) for c in rng.integers(0, 3, n)]
    frame = spark.createDataFrame([*data, (None, [0.0] * dim), (9, [1.0] * dim), (1, None)], "label int, x array<double>").repartition(3)
    return frame, Mixture([0, 1, 2], np.array([0.2, 0.5, 0.3]), rng.normal(size=(3, dim)), np.exp(0.3 * rng.normal(size=(3, dim)))), data


def by_hand(mixture: Mixture, data) -> float:
    x, at = np.array([r[1] for r in data]), np.array([r[0] for r in data])
    joint = mixture.log_densities(x) + np.log(mixture.weights)
    return float((joint[np.arange(len(at)), at] - np.log(np.exp(joint).sum(1))).sum())


def test_slopes_of_mutual_information_are_those_of_small_steps(spark):
    frame, mixture, data = sample(spark)
    value, slopes = discriminative.mutual_information(frame, "label", "x", mixture)
    assert value == pytest.approx(by_hand(mixture, data))
    h = 1e-5

    def moved(means=0.0, variances=0.0, weights=0.0) -> Mixture:
        w = mixture.weights * np.exp(weights)
        return Mixture(mixture.ids, w / w.sum(), mixture.means + means, mixture.variances * np.exp(variances))

    for name in ("means", "variances"):
        for at in ((0, 0), (1, 2), (2, 1)):
            e = np.zeros(mixture.means.shape)
            e[at] = h
            assert slopes[name][at] == pytest.approx((by_hand(moved(**{name: e}), data) - by_hand(moved(**{name: -e}), data)) / (2 * h), rel=1e-5, abs=1e-5)
    for i in range(3):
        e = np.zeros(3)
        e[i] = h
        assert slopes["weights"][i] == pytest.approx((by_hand(moved(weights=e), data) - by_hand(moved(weights=-e), data)) / (2 * h), rel=1e-5, abs=1e-5)


def test_mutual_information_climbs(spark):
    frame, mixture, data = sample(spark)
    trained, values = discriminative.train_mutual_information(frame, "label", "x", mixture, rounds=8)
    assert values[0] == pytest.approx(by_hand(mixture, data)) and values[-1] == pytest.approx(by_hand(trained, data))
    assert all(b > a for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0] + 50
    assert trained.weights.sum() == pytest.approx(1.0)


def test_steps_meet_both_conditions():
    """A function with a long curved ridge: every step climbs, and the slope along it has fallen."""
    seen = []

    def ridge(x):
        a, b = x
        value = -((1 - a) ** 2) - 100 * (b - a * a) ** 2
        return value, np.array([2 * (1 - a) + 400 * a * (b - a * a), -200 * (b - a * a)])

    def checked(x):
        seen.append(1)
        return ridge(x)

    history: list[float] = []
    best = discriminative.maximize(checked, np.array([-1.2, 1.0]), rounds=200, history=history)
    np.testing.assert_allclose(best, [1.0, 1.0], atol=1e-5)
    assert all(b > a for a, b in zip(history, history[1:], strict=False)) and len(seen) < 200
    x, d = np.array([-1.2, 1.0]), np.array([0.3, 0.1])
    value, slope = ridge(x)
    d = d if d @ slope > 0 else -d
    size, new, after = discriminative._step(ridge, x, d, value, d @ slope)
    assert new >= value + discriminative.CLIMB * size * (d @ slope) and d @ after <= discriminative.CURVATURE * (d @ slope)
