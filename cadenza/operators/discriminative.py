"""Discriminative re-estimation by extended Baum-Welch, and distances between mixtures by sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .statistics import VARIANCE_FLOOR, Mixture

#: The least mixture weight and the rounds of its update.
WEIGHT_FLOOR, WEIGHT_ROUNDS = 1e-8, 1000


def least_smoothing(gamma: float, sum1: np.ndarray, sum2: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> float:
    """The least D from which all variances of the update are positive: the largest root of their quadratics."""
    a = variance
    b = sum2 + gamma * (variance + mean**2) - 2 * mean * sum1
    c = gamma * sum2 - sum1**2
    inside = b * b - 4 * a * c
    roots = np.where(inside >= 0, (-b + np.sqrt(np.maximum(inside, 0))) / (2 * a), 0.0)
    return float(max(0.0, roots.max(), -gamma))


def ebw_gaussian(num: tuple[float, np.ndarray, np.ndarray], den: tuple[float, np.ndarray, np.ndarray], mean: np.ndarray, variance: np.ndarray, c1: float = 2.0, c2: float = 2.0, tau: float = 0.0, floor: float = VARIANCE_FLOOR) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, variance and D from numerator and denominator moments (gamma, sum1, sum2); D = max(c1 gamma_den + tau, c2 least)."""
    gamma, s1, s2 = (n - d for n, d in zip(num, den, strict=True))
    d = max(c1 * den[0] + tau, c2 * least_smoothing(gamma, s1, s2, mean, variance), 1e-12)
    new = (s1 + d * mean) / (gamma + d)
    return new, np.maximum((s2 + d * (variance + mean**2)) / (gamma + d) - new**2, floor), d


def divergence(mean: np.ndarray, variance: np.ndarray, old_mean: np.ndarray, old_variance: np.ndarray) -> float:
    """How far an update moves a Gaussian: the greater of the divergence of the means and that of the variances."""
    moved = ((mean - old_mean) ** 2 / old_variance).sum() / 2
    ratio = variance / old_variance
    return float(max(moved, (ratio - np.log(ratio) - 1).sum() / 2))


def ebw_limited(num: tuple[float, np.ndarray, np.ndarray], den: tuple[float, np.ndarray, np.ndarray], mean: np.ndarray, variance: np.ndarray, limit: float, floor: float = VARIANCE_FLOOR, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """The update with the least D, found by bisection, by which the Gaussian moves no more than `limit`."""
    gamma, s1, s2 = (n - d for n, d in zip(num, den, strict=True))
    low = max(2 * least_smoothing(gamma, s1, s2, mean, variance), 1e-6)

    def step(d: float) -> tuple[np.ndarray, np.ndarray]:
        new = (s1 + d * mean) / (gamma + d)
        return new, np.maximum((s2 + d * (variance + mean**2)) / (gamma + d) - new**2, floor)

    far = lambda d: divergence(*step(d), mean, variance)
    if far(low) > limit:
        high = 2 * low
        while far(high) > limit:
            low, high = high, 2 * high
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if far(middle) > limit else (low, middle)
        low = high
    return *step(low), low


def ebw_weights(num: np.ndarray, den: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mixture weights of the auxiliary function of numerator and denominator occupancies, by fixed-point rounds."""
    share = den / np.maximum(weights, WEIGHT_FLOOR)
    w = weights.copy()
    for _ in range(WEIGHT_ROUNDS):
        new = np.maximum(num + (share.max() - share) * w, 0)
        new = np.maximum(new / max(new.sum(), 1e-300), WEIGHT_FLOOR)
        new /= new.sum()
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def update_gaussians(num: DataFrame, den: DataFrame, mixture: Mixture, key: str, limit: float | None = None, **options: float) -> DataFrame:
    """key, mean, variance, d of each Gaussian, from tables of moments (key, gamma, sum1, sum2) of both sides.

    With `limit` no Gaussian moves further than that divergence.

    One row per Gaussian meets in a join; rows are updated in Arrow batches.
    """
    place = {k: i for i, k in enumerate(mixture.ids)}
    kind = num.schema[key].dataType.simpleString()
    side = lambda df, p: df.select(F.col(key).alias("k"), F.col("gamma").alias(f"{p}g"), F.col("sum1").alias(f"{p}1"), F.col("sum2").alias(f"{p}2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                i = place[r["k"]]
                zero = np.zeros(mixture.means.shape[1])
                sides = [(r[f"{p}g"] or 0.0, np.array(r[f"{p}1"]) if r[f"{p}1"] is not None else zero, np.array(r[f"{p}2"]) if r[f"{p}2"] is not None else zero) for p in "nd"]
                update = ebw_gaussian(*sides, mixture.means[i], mixture.variances[i], **options) if limit is None else ebw_limited(*sides, mixture.means[i], mixture.variances[i], limit)
                out.append((r["k"], *update))
            k, m, v, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field("k").type), pa.array(list(m), pa.list_(pa.float64())), pa.array(list(v), pa.list_(pa.float64())), pa.array(d, pa.float64())], names=["k", "mean", "variance", "d"])

    return side(num, "n").join(side(den, "d"), "k", "full").mapInArrow(run, f"k {kind}, mean array<double>, variance array<double>, d double").withColumnRenamed("k", key)


def sampled_distances(spark: SparkSession, a: Mixture, b: Mixture, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """kl (of a from b), cross_entropy and bhattacharyya, as means over samples of a; each task draws its own, seeded by its rows."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            if not len(ids):
                continue
            rng = np.random.default_rng([seed, int(ids[0])])
            g = rng.choice(len(a.ids), len(ids), p=a.weights / a.weights.sum())
            x = a.means[g] + rng.normal(size=(len(ids), a.means.shape[1])) * np.sqrt(a.variances[g])
            la, lb = a.posteriors(x)[1], b.posteriors(x)[1]
            yield pa.RecordBatch.from_arrays([pa.array(la), pa.array(lb)], names=["la", "lb"])

    drawn = spark.range(0, samples, 1, max(1, samples // 2000)).mapInArrow(draw, "la double, lb double")
    return drawn.agg(F.avg(F.col("la") - F.col("lb")).alias("kl"), F.avg(-F.col("lb")).alias("cross_entropy"), (-F.log(F.avg(F.exp((F.col("lb") - F.col("la")) / 2)))).alias("bhattacharyya"))


#: Conditions on a step: the share of the first slope by which it climbs at least, and to which the slope falls.
CLIMB, CURVATURE = 1e-4, 0.9


def _step(value_and_slope, x: np.ndarray, direction: np.ndarray, value: float, rise: float, most: int = 40) -> tuple[float, float, np.ndarray] | None:
    """A step that climbs enough and after which the slope along it has fallen enough, by doubling and halving; None if there is none."""
    low, high, size, found = 0.0, np.inf, 1.0, None
    for _ in range(most):
        new, slope = value_and_slope(x + size * direction)
        if not new >= value + CLIMB * size * rise:
            high = size
        else:
            found = (size, new, slope)  # good enough, if nothing better comes
            if direction @ slope <= CURVATURE * rise:
                return found
            low = size
        size = 2 * low if np.isinf(high) else (low + high) / 2
        if high - low < 1e-12 * max(1.0, high):
            break
    return found


def maximize(value_and_slope, start: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-6, history: list[float] | None = None) -> np.ndarray:
    """Ascent with a limited memory of curvature; steps meet both a condition on the climb and one on the slope after them, so each
    tells of the curvature. `value_and_slope` may run Spark jobs: one per call. Values go to `history`, the first one too."""
    x = np.array(start, float)
    value, slope = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    values = [] if history is None else history
    values.append(float(value))
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        q, kept = slope.copy(), []
        for s, y in reversed(steps):
            alpha = s @ q / (s @ y)
            kept.append(alpha)
            q -= alpha * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(steps, reversed(kept), strict=True):
            q += s * (alpha - y @ q / (s @ y))
        direction = (q if q @ slope > 0 else slope) if steps else slope / max(1.0, np.abs(slope).max())
        found = _step(value_and_slope, x, direction, value, direction @ slope)
        if found is None:
            break
        size, new, after = found
        s, y = size * direction, slope - after
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, slope = x + s, new, after
        values.append(float(value))
    return x


def mutual_information(rows: DataFrame, key: str, vector: str, mixture: Mixture) -> tuple[float, dict[str, np.ndarray]]:
    """What the logarithms of the classes' posteriors of rows with a class and a vector add up to, and its slopes.

    Classes are the mixture's Gaussians with their weights. Slopes are by means, by logarithms of variances and by logarithms of weights (that
    are made to add up to 1). One Spark aggregate: tasks add up signed moments, which the slopes are made of; what is shuffled is one row
    per class and task. Rows without a vector or of no class do not count.
    """
    sent = rows.sparkSession.sparkContext.broadcast(mixture)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = sent.value
        place = {k: i for i, k in enumerate(mixture.ids)}
        value, gamma = 0.0, np.zeros(len(place))
        first, second = np.zeros(mixture.means.shape), np.zeros(mixture.means.shape)
        for batch in batches:
            at = np.array([place.get(k, -1) for k in batch.column("k").to_pylist()], np.int64)
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)[at >= 0]
            at = at[at >= 0]
            if not len(at):
                continue
            posterior, total = mixture.posteriors(x)
            joint = mixture.log_densities(x)[np.arange(len(at)), at] + np.log(mixture.weights[at])
            value += (joint - total).sum()
            signed = -posterior
            signed[np.arange(len(at)), at] += 1
            gamma += signed.sum(0)
            first += signed.T @ x
            second += signed.T @ x**2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(place))), pa.array(np.full(len(place), value / len(place))), pa.array(gamma), pa.array(list(first), pa.list_(pa.float64())), pa.array(list(second), pa.list_(pa.float64()))], names=["i", "value", "gamma", "sum1", "sum2"])

    narrow = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).where(F.col("k").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    parts = narrow.mapInArrow(partial, "i long, value double, gamma double, sum1 array<double>, sum2 array<double>")
    scalars = parts.groupBy("i").agg(F.sum("value").alias("value"), F.sum("gamma").alias("gamma"))
    vectors = parts.select("i", F.posexplode(F.arrays_zip("sum1", "sum2")).alias("d", "s")).groupBy("i", "d").agg(F.sum("s.sum1").alias("a"), F.sum("s.sum2").alias("b"))
    vectors = vectors.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "a", "b"))).alias("v"))
    found = scalars.join(vectors, "i").orderBy("i").collect()  # a row per Gaussian
    if not found:
        return 0.0, {"means": np.zeros(mixture.means.shape), "variances": np.zeros(mixture.means.shape), "weights": np.zeros(len(mixture.ids))}
    gamma = np.array([r["gamma"] for r in found])[:, None]
    first, second = (np.array([[x[c] for x in r["v"]] for r in found]) for c in ("a", "b"))
    by_mean = (first - gamma * mixture.means) / mixture.variances
    spread = second - 2 * mixture.means * first + gamma * mixture.means**2
    by_variance = 0.5 * (spread / mixture.variances - gamma)
    return float(sum(r["value"] for r in found)), {"means": by_mean, "variances": by_variance, "weights": gamma[:, 0] - mixture.weights * gamma.sum()}


def train_mutual_information(rows: DataFrame, key: str, vector: str, mixture: Mixture, rounds: int = 20, memory: int = 8) -> tuple[Mixture, list[float]]:
    """The mixture after so many rounds of ascent of `mutual_information` by means, variances and weights, and the values of the rounds."""
    n, dim = mixture.means.shape

    def packed(m: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.concatenate([m.ravel(), v.ravel(), w])

    def unpacked(x: np.ndarray) -> Mixture:
        w = np.exp(x[2 * n * dim :] - x[2 * n * dim :].max())
        return Mixture(mixture.ids, w / w.sum(), x[: n * dim].reshape(n, dim), np.exp(x[n * dim : 2 * n * dim]).reshape(n, dim))

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slopes = mutual_information(rows, key, vector, unpacked(x))
        return value, packed(slopes["means"], slopes["variances"], slopes["weights"])

    history: list[float] = []
    start = packed(mixture.means, np.log(mixture.variances), np.log(np.maximum(mixture.weights, 1e-300)))
    return unpacked(maximize(value_and_slope, start, rounds, memory, history=history)), history
