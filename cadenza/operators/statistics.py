"""Weighted sufficient statistics of vectors and estimates from them.

Moments are summed in Arrow batches before the shuffle: what is shuffled is one row per
class and task. Models (means and variances per Gaussian) are small and travel to
the tasks in closures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least density, variance and transition probability.
DENSITY_FLOOR, VARIANCE_FLOOR, TRANSITION_FLOOR = 1e-50, 1e-6, 0.001
#: Fixed value: the least variance of durations.
VARIANCE_OF_DURATION = 0.25


def moments(rows: DataFrame, key: str, vector: str, weight: str, full: bool = False) -> DataFrame:
    """key, n, gamma, sum1 (of weighted x), sum2 (of weighted x*x, or with `full` the lower triangle of x x').

    Rows without a vector or weight, or with a null in the vector, do not count.
    """
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            g, keys = np.asarray(batch.column("g"), float), batch.column("k").to_pandas()
            for k, at in keys.groupby(keys, dropna=False).indices.items():
                part, w = x[at], g[at]
                square = ((part * w[:, None]).T @ part)[np.tril_indices(part.shape[1])] if full else w @ part**2
                new = (len(at), w.sum(), w @ part, square)
                old = total.get(k)
                total[k] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
        if total:
            n, g, s1, s2 = zip(*total.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(total)).cast(batch.schema.field("k").type), pa.array(n, pa.int64()), pa.array(g, pa.float64()), pa.array(list(s1)), pa.array(list(s2))], names=["k", "n", "gamma", "sum1", "sum2"])

    narrow = rows.select(F.col(key).alias("k"), F.col(weight).cast("double").alias("g"), F.col(vector).cast("array<double>").alias("x"))
    narrow = narrow.where(F.col("x").isNotNull() & F.col("g").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    parts = narrow.mapInArrow(partial, f"k {kind}, n long, gamma double, sum1 array<double>, sum2 array<double>")
    return add_moments(parts.withColumnRenamed("k", key), key)


def add_moments(parts: DataFrame, key: str) -> DataFrame:
    """Sum partial moments, of tasks or of stored runs, into one row per key."""
    scalars = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("gamma").alias("gamma"))
    vectors = parts.select(key, F.posexplode(F.arrays_zip("sum1", "sum2")).alias("i", "s")).groupBy(key, "i").agg(F.sum("s.sum1").alias("a"), F.sum("s.sum2").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "a", "b")))
    vectors = vectors.groupBy(key).agg(ordered.alias("v")).select(F.col(key).alias("_k"), F.filter(F.col("v.a"), lambda a: a.isNotNull()).alias("sum1"), F.col("v.b").alias("sum2"))
    return scalars.join(vectors, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def gaussian_ml(stats: DataFrame, floor: float = VARIANCE_FLOOR) -> DataFrame:
    """mean and variance (not below `floor`) from diagonal moments."""
    mean = F.transform("sum1", lambda s: s / F.col("gamma"))
    out = stats.withColumn("mean", mean)
    variance = F.zip_with("sum2", "mean", lambda s, m: F.greatest(s / F.col("gamma") - m * m, F.lit(floor)))
    return out.withColumn("variance", variance)


def smooth(stats: Column, gamma: Column, source: Column, source_gamma: Column, tau: float) -> Column:
    """I-smoothing: statistics with tau / source_gamma of another model's added."""
    return F.zip_with(stats, source, lambda a, b: a + b * (F.lit(tau) / source_gamma))


def transition_estimates(counts: DataFrame, source: str, target: str, count: str, old: DataFrame | None = None) -> DataFrame:
    """Add p, the share of each target among its source's counts, not below the floor; rows are not normalized again.

    With `old` (source, target, p) its transitions are those of the result: one that has no count gets the floor,
    and a source without any counts keeps its old p.
    """
    if old is not None:
        counts = old.select(source, target, F.col("p").alias("_old")).join(counts.select(source, target, count), [source, target], "left")
        counts = counts.withColumn(count, F.coalesce(count, F.lit(0)))
    total = F.sum(count).over(Window.partitionBy(source))
    p = F.greatest(F.col(count) / F.when(total > 0, total), F.lit(TRANSITION_FLOOR))
    return counts.withColumn("p", p) if old is None else counts.withColumn("p", F.when(total > 0, p).otherwise(F.col("_old"))).drop("_old")


@dataclass
class Mixture:
    """Diagonal Gaussians with weights, ordered by id."""

    ids: list
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    @classmethod
    def from_rows(cls, model: DataFrame, key: str) -> Mixture:
        """From a table of key, gamma, mean, variance, which is small: one row per Gaussian."""
        rows = sorted(model.select(key, "gamma", "mean", "variance").collect())
        gamma = np.array([r[1] for r in rows], float)
        return cls([r[0] for r in rows], gamma / gamma.sum(), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Natural logarithm of each Gaussian's density at each row of x."""
        inv = 1 / self.variances
        const = -0.5 * (np.log(2 * np.pi * self.variances).sum(1) + (self.means**2 * inv).sum(1))
        return const - 0.5 * (x**2 @ inv.T) + x @ (self.means * inv).T

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and the logarithm of the mixture's density."""
        joint = self.log_densities(x) + np.log(np.maximum(self.weights, 1e-300))
        top = joint.max(1, keepdims=True)
        total = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
        return np.exp(joint - total), total[:, 0]


def score_mixture(rows: DataFrame, vector: str, mixture: Mixture) -> DataFrame:
    """Add log_densities and posteriors (arrays by Gaussian) and log_mixture."""

    @F.pandas_udf("struct<log_densities:array<double>,posteriors:array<double>,log_mixture:double>")
    def score(s: pd.Series) -> pd.DataFrame:
        x = np.stack(s.to_numpy()).astype(float)
        p, total = mixture.posteriors(x)
        return pd.DataFrame({"log_densities": list(mixture.log_densities(x)), "posteriors": list(p), "log_mixture": total})

    return rows.withColumn("_s", score(F.col(vector).cast("array<double>"))).select("*", "_s.*").drop("_s")


def top_cluster_log_densities(rows: DataFrame, vector: str, mixture: Mixture, clusters: np.ndarray, best: int) -> DataFrame:
    """log_densities where only Gaussians of the `best` nearest clusters are exact; others get their cluster centre's.

    clusters holds the cluster of each Gaussian; a cluster's mean and variance are means of its members'.
    """
    names = np.unique(clusters)
    means = np.array([mixture.means[clusters == c].mean(0) for c in names])
    variances = np.array([mixture.variances[clusters == c].mean(0) for c in names])
    centres = Mixture(list(names), np.ones(len(names)) / len(names), means, variances)
    place = np.searchsorted(names, clusters)

    @F.pandas_udf("array<double>")
    def score(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(float)
        near = centres.log_densities(x)
        chosen = np.zeros(near.shape, bool)
        np.put_along_axis(chosen, np.argsort(-near, 1, kind="stable")[:, :best], True, 1)
        return pd.Series(list(np.where(chosen[:, place], mixture.log_densities(x), near[:, place])))

    return rows.withColumn("log_densities", score(F.col(vector).cast("array<double>")))


def nearest_means(rows: DataFrame, vector: str, mixture: Mixture) -> DataFrame:
    """Add nearest, the id of the Gaussian whose mean is nearest, the first of equals, and distance, its squared distance."""
    kind = "long" if all(isinstance(i, int) for i in mixture.ids) else "string"
    names = np.array(mixture.ids)

    @F.pandas_udf(f"struct<nearest:{kind},distance:double>")
    def find(s: pd.Series) -> pd.DataFrame:
        x = np.stack(s.to_numpy()).astype(float)
        gap = ((x[:, None] - mixture.means[None]) ** 2).sum(-1)
        at = gap.argmin(1)
        return pd.DataFrame({"nearest": names[at], "distance": gap[np.arange(len(x)), at]})

    return rows.withColumn("_n", find(F.col(vector).cast("array<double>"))).select("*", "_n.*").drop("_n")


def em_step(rows: DataFrame, vector: str, mixture: Mixture, floor: float = VARIANCE_FLOOR) -> tuple[Mixture, float]:
    """One round of expectation maximization: sums by task, then a small update here. Also the log-likelihood before."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = mixture.means.shape
        total = np.zeros((k, 2 * d + 1))
        ll = 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                p, logs = mixture.posteriors(x)
                total += np.concatenate([p.sum(0)[:, None], p.T @ x, p.T @ x**2], 1)
                ll += logs.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total)), pa.array([ll] + [0.0] * (k - 1))], names=["k", "s", "ll"])

    parts = rows.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(partial, "k long, s array<double>, ll double")
    sums = parts.select("k", "ll", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"), F.sum("ll").alias("ll")).collect()
    k, d = mixture.means.shape
    s = np.zeros((k, 2 * d + 1))
    for row in sums:
        s[row.k, row.i] = row.v
    ll = sum(row.ll for row in sums if row.k == 0 and row.i == 0)
    gamma = np.maximum(s[:, :1], 1e-300)
    alive = s[:, 0] > 1e-8
    means = np.where(alive[:, None], s[:, 1 : d + 1] / gamma, mixture.means)
    variances = np.where(alive[:, None], np.maximum(s[:, d + 1 :] / gamma - means**2, floor), mixture.variances)
    return Mixture(mixture.ids, s[:, 0] / s[:, 0].sum(), means, variances), ll


def split_largest(mixture: Mixture, count: int, minimum: float, alpha: float = 0.3, spread: float = 0.1) -> Mixture:
    """Split Gaussians by occupancy until `count`: the heaviest give two, moved apart along their deviations."""
    order = np.argsort(-(mixture.weights**alpha), kind="stable")
    chosen = [i for i in order if mixture.weights[i] >= minimum][: max(0, count - len(mixture.ids))]
    shift = spread * np.sqrt(mixture.variances[chosen])
    weights = mixture.weights.copy()
    weights[chosen] /= 2
    means = mixture.means.copy()
    means[chosen] += shift
    top = max((i for i in mixture.ids if isinstance(i, int)), default=len(mixture.ids))
    return Mixture(mixture.ids + list(range(top + 1, top + 1 + len(chosen))), np.concatenate([weights, weights[chosen]]), np.concatenate([means, mixture.means[chosen] - shift]), np.concatenate([mixture.variances, mixture.variances[chosen]]))


def drop_light(mixture: Mixture, least: float) -> Mixture:
    """Remove Gaussians of less weight, but never the heaviest."""
    kept = (mixture.weights >= least) | (np.arange(len(mixture.ids)) == mixture.weights.argmax())
    w = mixture.weights[kept]
    return Mixture([i for i, k in zip(mixture.ids, kept, strict=True) if k], w / w.sum(), mixture.means[kept], mixture.variances[kept])


def gaussian_kld(mean_a: np.ndarray, var_a: np.ndarray, mean_b: np.ndarray, var_b: np.ndarray) -> np.ndarray:
    """Kullback-Leibler divergence of diagonal Gaussians, summed over the last axis."""
    return 0.5 * (np.log(var_b / var_a) + (var_a + (mean_a - mean_b) ** 2) / var_b - 1).sum(-1)


def cluster_gaussians(mixture: Mixture, k: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Clusters of Gaussians: random centres by distance, then reassignment by divergence. Means of variances are the clusters'."""
    rng = np.random.default_rng(seed)
    centres = rng.choice(len(mixture.ids), min(k, len(mixture.ids)), replace=False)
    label = ((mixture.means[:, None] - mixture.means[centres][None]) ** 2).sum(-1).argmin(1)
    for _ in range(rounds):
        names = np.unique(label)
        means = np.array([mixture.means[label == c].mean(0) for c in names])
        variances = np.array([mixture.variances[label == c].mean(0) for c in names])
        new = names[gaussian_kld(mixture.means[:, None], mixture.variances[:, None], means[None], variances[None]).argmin(1)]
        if np.array_equal(new, label):
            break
        label = new
    return label


def gamma_fit(mean: float, mean_log: float, low: float = 1e-3, high: float = 1e3) -> tuple[float, float]:
    """Shape (between low and high) and scale of the gamma distribution of greatest likelihood, by golden section on the shape."""
    value = lambda a: a * math.log(a / mean) - math.lgamma(a) + (a - 1) * mean_log - a
    ratio = (math.sqrt(5) - 1) / 2
    low, high = math.log(low), math.log(high)
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = value(math.exp(a)), value(math.exp(b))
    for _ in range(100):
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = value(math.exp(b))
        else:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = value(math.exp(a))
    shape = math.exp((low + high) / 2)
    return shape, mean / shape


def gamma_log_density(d: Column, shape: Column, scale: Column, log_norm: Column) -> Column:
    """Log density of a duration; 0 where there is no model (shape not above 0). log_norm is lgamma(shape) + shape ln(scale)."""
    return F.when(shape <= 0, F.lit(0.0)).otherwise((shape - 1) * F.log(d) - d / scale - log_norm)


def gaussian_full(stats: DataFrame, floor: float = VARIANCE_FLOOR, smoothing: float = 0.0) -> DataFrame:
    """mean and covariance (the lower triangle, row by row) from full moments.

    Off the diagonal covariances are multiplied by n / (n + smoothing), n being gamma; variances are not below `floor`.
    """
    out = stats.withColumn("mean", F.transform("sum1", lambda s: s / F.col("gamma")))
    dim = F.size("mean")
    places = F.flatten(F.transform(F.sequence(F.lit(1), dim), lambda i: F.transform(F.sequence(F.lit(1), i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    keep = F.col("gamma") / (F.col("gamma") + F.lit(float(smoothing)))

    def entry(s: Column, at: Column) -> Column:
        value = s / F.col("gamma") - F.element_at("mean", at["i"]) * F.element_at("mean", at["j"])
        return F.when(at["i"] == at["j"], F.greatest(value, F.lit(floor))).otherwise(value * keep)

    return out.withColumn("covariance", F.zip_with("sum2", places, entry))


def state_likelihoods(densities: DataFrame, frame: list[str], mixtures: DataFrame, normalized: bool = True) -> DataFrame:
    """Frame columns, state and lp: the log likelihood of each state at each frame, made to add up to 1 over states.

    `densities` has the frame columns, gid and ld (the log density of a Gaussian), `mixtures` state, gid and
    weight. The join is on the Gaussian; a state's sum is taken around its greatest term. A density is not
    below the floor, as is the argument of the logarithm.
    """
    rows = densities.join(mixtures.select("state", "gid", "weight"), "gid")
    joint = F.col("ld") + F.log("weight")
    per = rows.withColumn("joint", joint).groupBy(*frame, "state").agg(F.max("joint").alias("top"), F.collect_list("joint").alias("all"))
    whole = F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    per = per.select(*frame, "state", F.greatest(whole, F.lit(math.log(DENSITY_FLOOR))).alias("lp"))
    if not normalized:
        return per
    w = Window.partitionBy(*frame)
    best = per.withColumn("best", F.max("lp").over(w))
    total = best.withColumn("z", F.log(F.sum(F.exp(F.col("lp") - F.col("best"))).over(w)))
    return total.select(*frame, "state", F.greatest(F.col("lp") - F.col("best") - F.col("z"), F.lit(math.log(DENSITY_FLOOR))).alias("lp"))


def gamma_models(durations: DataFrame, key: str, duration: str, least: int = 2, skip: int = 0) -> DataFrame:
    """key, n, shape and scale of the durations of each state, 0 and 0 for a state with fewer than `least` of them.

    The shape is sought from 1 to 2 max(mean^2 / variance, 1.5) - 1, the variance being at least 0.25.
    """
    d = F.col(duration).cast("double")
    sums = durations.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.var_samp(d), F.lit(0.0)).alias("var"), F.avg(F.log(d)).alias("mean_log"))

    @F.pandas_udf("struct<shape:double,scale:double>")
    def fit(n: pd.Series, mean: pd.Series, var: pd.Series, mean_log: pd.Series) -> pd.DataFrame:
        out = []
        for count, m, v, ml in zip(n, mean, var, mean_log, strict=True):
            if count < max(2, least):
                out.append((0.0, 0.0))
                continue
            high = 2 * max(m * m / max(v, VARIANCE_OF_DURATION), 1.5) - 1
            shape = gamma_fit(m, ml, 1.0, high)[0]
            out.append((shape, m / shape))
        return pd.DataFrame(out, columns=["shape", "scale"])

    return sums.withColumn("f", fit("n", "mean", "var", "mean_log")).select(key, "n", "f.shape", "f.scale")


def split_counts(occupancies: np.ndarray, count: int, minimum: float, alpha: float = 0.3, rounds: int = 30) -> np.ndarray:
    """How many Gaussians each mixture should have so that all together have `count`: occupancy^alpha over a divisor found by bisection, 1 at least.

    A mixture never gets more than one Gaussian for each `minimum` of its occupancy.
    """
    power = np.maximum(occupancies, 1e-300) ** alpha
    most = np.maximum(1, np.floor(occupancies / minimum)).astype(int)
    wanted = lambda divisor: np.clip(np.floor(power / divisor), 1, most).astype(int)
    low, high = 1e-12, float(power.max()) + 1.0
    for _ in range(rounds):
        middle = math.sqrt(low * high)
        if wanted(middle).sum() > count:
            low = middle
        else:
            high = middle
    return wanted(high)


def removals(occupancies: DataFrame, mixture: str, occupancy: str, least: float, order: str) -> DataFrame:
    """Rows of Gaussians that stay: those of `least` occupancy, and the heaviest of each mixture in any case."""
    w = Window.partitionBy(mixture).orderBy(F.desc(occupancy), order)
    return occupancies.withColumn("_place", F.row_number().over(w)).where((F.col(occupancy) >= least) | (F.col("_place") == 1)).drop("_place")
