"""Transforms estimated from statistics: LDA, PCA, MLLT, CMLLR, quantile equalization, warp grids.

Statistics are Spark aggregates of fixed size; the small dense problems on them are
solved here with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import Mixture, moments
from .training import States


def symmetric(triangle: list[float], dim: int) -> np.ndarray:
    """The matrix whose lower triangle is given row by row."""
    out = np.zeros((dim, dim))
    out[np.tril_indices(dim)] = triangle
    return out + np.tril(out, -1).T


def lda(rows: DataFrame, key: str, vector: str, weight: str, out: int, most: float = float("inf")) -> np.ndarray:
    """Directions that part the classes: eigenvectors of W^-1 B, scaled so that W is white. A class counts `most` at most."""
    stats = moments(rows, key, vector, weight, full=True).orderBy(key).collect()
    dim = len(stats[0]["sum1"])
    within, means, gammas = np.zeros((dim, dim)), [], []
    for s in stats:
        g = s["gamma"]
        mean = np.array(s["sum1"]) / g
        cap = min(g, most)
        within += cap * (symmetric(s["sum2"], dim) / g - np.outer(mean, mean))
        means.append(mean)
        gammas.append(cap)
    gamma, mean = np.array(gammas), np.array(means)
    within /= gamma.sum()
    gap = mean - (gamma @ mean) / gamma.sum()
    between = (gap * gamma[:, None]).T @ gap / gamma.sum()
    values, vectors = np.linalg.eigh(within + 1e-9 * np.eye(dim))
    white = vectors / np.sqrt(np.maximum(values, 1e-12))
    v, u = np.linalg.eigh(white.T @ between @ white)
    order = np.argsort(-v)[:out]
    a = (white @ u[:, order]).T
    return a * np.sign(a[np.arange(out), np.abs(a).argmax(1)])[:, None]


def pca(rows: DataFrame, vector: str, unit_determinant: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions, each divided by its deviation; perhaps scaled to determinant 1."""
    s = moments(rows.withColumns({"_all": F.lit(0), "_one": F.lit(1.0)}), "_all", vector, "_one", full=True).first()
    dim = len(s["sum1"])
    mean = np.array(s["sum1"]) / s["gamma"]
    values, vectors = np.linalg.eigh(symmetric(s["sum2"], dim) / s["gamma"] - np.outer(mean, mean))
    order = np.argsort(-values)
    a = (vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))).T
    a = a * np.sign(a[np.arange(dim), np.abs(a).argmax(1)])[:, None]
    return mean, a / abs(np.linalg.det(a)) ** (1 / dim) if unit_determinant else a


def mllt(covariances: np.ndarray, gammas: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A square transform of determinant 1 under which the classes' covariances are nearly diagonal."""
    dim = covariances.shape[1]
    a, beta = np.eye(dim), gammas.sum()
    for _ in range(rounds):
        variance = np.maximum(np.einsum("ij,kjl,il->ki", a, covariances, a), 1e-12)
        for i in range(dim):
            g = np.einsum("k,kij->ij", gammas / variance[:, i], covariances)
            cofactor = np.linalg.inv(a).T[i] * np.linalg.det(a)
            row = np.linalg.solve(g, cofactor)
            a[i] = row * np.sqrt(beta / max(cofactor @ row, 1e-300))
        a /= abs(np.linalg.det(a)) ** (1 / dim)
    return a


def cmllr_statistics(rows: DataFrame, key: str, vector: str, mixture: Mixture) -> DataFrame:
    """key, beta and s: the statistics G_i and k_i of each element, in one array; responsibilities are the mixture's."""
    kind = rows.schema[key].dataType.simpleString()
    dim = mixture.means.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            p, _ = mixture.posteriors(x)
            one = np.concatenate([np.ones((len(x), 1)), x], 1)
            keys = batch.column("k").to_pandas()
            for k, at in keys.groupby(keys, dropna=False).indices.items():
                inv = p[at] @ (1 / mixture.variances)
                shift = p[at] @ (mixture.means / mixture.variances)
                g = np.einsum("ni,nj,nk->ijk", inv, one[at], one[at]).ravel()
                s = np.concatenate([g, np.einsum("ni,nj->ij", shift, one[at]).ravel(), [p[at].sum()]])
                total[k] = total.get(k, 0) + s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)).cast(batch.schema.field("k").type), pa.array(list(total.values()))], names=["k", "s"])

    parts = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(partial, f"k {kind}, s array<double>")
    sums = parts.select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s")).withColumn("dim", F.lit(dim)).withColumnRenamed("k", key)


def cmllr_transform(s: np.ndarray, dim: int, rounds: int = 20) -> np.ndarray:
    """b and A, as rows (b_i, a_i), of greatest likelihood, row by row; of two roots the better one."""
    n = dim + 1
    g, k, beta = s[: dim * n * n].reshape(dim, n, n), s[dim * n * n : -1].reshape(dim, n), s[-1]
    g = g + 1e-8 * np.eye(n)
    w = np.concatenate([np.zeros((dim, 1)), np.eye(dim)], 1)
    inverse = np.linalg.inv(g)
    for _ in range(rounds):
        for i in range(dim):
            cofactor = np.append(0.0, np.linalg.inv(w[:, 1:]).T[i] * np.linalg.det(w[:, 1:]))
            p, q = cofactor @ inverse[i] @ cofactor, cofactor @ inverse[i] @ k[i]
            best = None
            for root in (-q + np.sqrt(q * q + 4 * p * beta), -q - np.sqrt(q * q + 4 * p * beta)):
                row = inverse[i] @ (root / (2 * p) * cofactor + k[i])
                value = beta * np.log(max(abs(cofactor @ row), 1e-300)) - 0.5 * row @ g[i] @ row + row @ k[i]
                if best is None or value > best[0]:
                    best = (value, row)
            w[i] = best[1]
    return w


def quantile_equalization(quantiles: np.ndarray, training: np.ndarray, alphas: np.ndarray, gammas: np.ndarray) -> tuple[float, float]:
    """alpha and gamma of a grid that bring quantiles, over their last one, nearest to the training's; not below these at first."""
    top = max(quantiles[-1], training[-1])
    x = np.maximum(quantiles, training)[:-1] / top
    a, g = np.meshgrid(alphas, gammas, indexing="ij")
    error = ((a[..., None] * x ** g[..., None] + (1 - a[..., None]) * x - training[:-1] / top) ** 2).sum(-1)
    i, j = np.unravel_index(error.argmin(), error.shape)
    return float(alphas[i]), float(gammas[j])


def best_warp(frames: DataFrame, key: str, value: str, warps: list[float], mean: float, variance: float) -> DataFrame:
    """key, warp, ll: of a grid the warp with the greatest likelihood of the warped values, and that; least warp in ties."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in warps]))
    rows = frames.select(key, value, grid.alias("warp"))
    gap = F.col(value) * F.col("warp") - F.lit(float(mean))
    ll = F.sum(F.log("warp") - gap * gap / F.lit(2.0 * variance))
    sums = rows.groupBy(key, "warp").agg(ll.alias("ll"))
    best = sums.groupBy(key).agg(F.max_by(F.struct("warp", "ll"), F.struct("ll", -F.col("warp"))).alias("b"))
    return best.select(key, "b.warp", "b.ll")


def warp_scores(frames: DataFrame, key: str, vector: str, state: str, matrices: dict[float, np.ndarray], model: States, floor: float | None = None) -> DataFrame:
    """key, warp and ll: the log likelihood of a speaker's frames, each warped by a matrix and scored by the mixture of its aligned state.

    All warps are taken in one pass over the arrays of a batch; tasks add up speakers' sums before the shuffle. No element
    of a warped vector is below `floor`. Rows without a speaker, a state or a whole vector do not count.
    """
    kind = frames.schema[key].dataType.simpleString()
    warps, stack = list(matrices), np.stack(list(matrices.values()))
    sent = frames.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            states = np.asarray(batch.column("s"))
            warped = np.einsum("wij,nj->wni", stack, x)
            warped = warped if floor is None else np.maximum(warped, floor)
            value = np.empty((len(x), len(warps)))
            for s in np.unique(states):
                at = np.flatnonzero(states == s)
                joint = sent.value.joint(warped[:, at].reshape(-1, warped.shape[2]), np.array([s]))[:, 0]
                top = joint.max(1)
                value[at] = (top + np.log(np.exp(joint - top[:, None]).sum(1))).reshape(len(warps), len(at)).T
            keys = batch.column("k").to_pandas()
            for k, at in keys.groupby(keys, dropna=False).indices.items():
                total[k] = total.get(k, 0.0) + value[at].sum(0)
        if total:
            names = pa.array(list(total)).cast(batch.schema.field("k").type)
            yield pa.RecordBatch.from_arrays([names, pa.array(list(total.values()), pa.list_(pa.float64()))], names=["k", "v"])

    rows = frames.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"), F.col(state).cast("int").alias("s"))
    rows = rows.where(F.col("k").isNotNull() & F.col("x").isNotNull() & F.col("s").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    parts = rows.mapInArrow(partial, f"k {kind}, v array<double>").select("k", F.posexplode("v").alias("i", "ll"))
    warp = F.element_at(F.array(*[F.lit(float(w)) for w in warps]), F.col("i") + 1)
    return parts.groupBy("k", "i").agg(F.sum("ll").alias("ll")).select(F.col("k").alias(key), warp.alias("warp"), "ll")


def best_warps(scores: DataFrame, key: str) -> DataFrame:
    """key, warp, ll: the warp of greatest likelihood of each speaker, the least one in ties."""
    best = F.max_by(F.struct("warp", "ll"), F.struct("ll", -F.col("warp")))
    return scores.groupBy(key).agg(best.alias("b")).select(key, "b.warp", "b.ll")


def occupancies(rows: DataFrame, key: str, vector: str, mixture: Mixture) -> DataFrame:
    """key, gid, gamma, sum1: what each speaker's vectors give to each Gaussian by its posteriors, added up in tasks first. Rows without a speaker or with nulls in the vector do not count."""
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(mixture)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            p, _ = sent.value.posteriors(x)
            keys = batch.column("k").to_pandas()
            for k, at in keys.groupby(keys, dropna=False).indices.items():
                total[k] = total.get(k, 0.0) + np.concatenate([p[at].sum(0)[:, None], p[at].T @ x[at]], 1)
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(s)).cast(batch.schema.field("k").type), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(list(s), pa.list_(pa.float64()))], names=["k", "i", "s"])

    narrow = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).where(F.col("k").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    parts = narrow.mapInArrow(partial, f"k {kind}, i int, s array<double>").select("k", "i", F.posexplode("s").alias("d", "v"))
    sums = parts.groupBy("k", "i", "d").agg(F.sum("v").alias("v")).groupBy("k", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("s"))
    return sums.select(F.col("k").alias(key), F.col("i").alias("gid"), F.element_at("s", 1).alias("gamma"), F.expr("slice(s, 2, size(s) - 1)").alias("sum1"))


def mean_transform(gamma: np.ndarray, first: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Rows (b_i, a_i) by which the means of Gaussians become those of greatest likelihood for occupancies and first moments."""
    one = np.concatenate([np.ones((len(means), 1)), means], 1)
    out = np.empty((means.shape[1], means.shape[1] + 1))
    for i in range(means.shape[1]):
        g = (one * (gamma / variances[:, i])[:, None]).T @ one
        out[i] = np.linalg.solve(g + 1e-8 * np.trace(g) / len(g) * np.eye(len(g)), (first[:, i] / variances[:, i]) @ one)
    return out


def class_transforms(stats: DataFrame, key: str, leaf_of: np.ndarray, parents: list[int], mixture: Mixture, least: float) -> DataFrame:
    """key, leaf, node, gamma and transform (of means, its rows in one array) for each speaker and leaf of `trees.class_tree`.

    A leaf takes the transform of its nearest ancestor, itself first, whose Gaussians have `least` occupancy with that speaker; where not even
    the root has it, node and transform are null. Statistics of `occupancies` are added up the tree; a node's
    transform is found once for all leaves that take it.
    """
    spark, kind = stats.sparkSession, stats.schema[key].dataType.simpleString()
    leaves = sorted(set(leaf_of.tolist()))
    above = []
    for leaf in leaves:
        node, height = leaf, 0
        while node >= 0:
            above.append((leaf, node, height))
            node, height = parents[node], height + 1
    ancestors = F.broadcast(spark.createDataFrame(above, "leaf int, node int, height int"))  # the model's tree
    gaussians = F.broadcast(spark.createDataFrame([(i, int(k)) for i, k in enumerate(leaf_of)], "gid int, leaf int"))
    rows = stats.withColumnRenamed(key, "k").join(gaussians, "gid")
    per_node = rows.groupBy("k", "leaf").agg(F.sum("gamma").alias("gamma")).join(ancestors, "leaf").groupBy("k", "node").agg(F.sum("gamma").alias("gamma"))
    enough = per_node.where(F.col("gamma") >= least).join(ancestors, "node")
    chosen = enough.groupBy("k", "leaf").agg(F.min_by(F.struct("node", "gamma"), "height").alias("c")).select("k", "leaf", "c.*")
    used = chosen.select("k", "node").distinct()
    held = rows.join(ancestors, "leaf").join(used, ["k", "node"]).groupBy("k", "node").agg(F.collect_list(F.struct("gid", "gamma", "sum1")).alias("held"))  # a node's Gaussians
    sent = spark.sparkContext.broadcast(mixture)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = []
            for each in batch.column("held").to_pylist():
                each = sorted(each, key=lambda r: r["gid"])
                at = [r["gid"] for r in each]
                found.append(mean_transform(np.array([r["gamma"] for r in each]), np.array([r["sum1"] for r in each]), model.means[at], model.variances[at]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("node"), pa.array(found, pa.list_(pa.float64()))], names=["k", "node", "transform"])

    solved = held.mapInArrow(solve, f"k {kind}, node int, transform array<double>")
    every = stats.select(F.col(key).alias("k")).distinct().withColumn("leaf", F.explode(F.array(*[F.lit(int(x)) for x in leaves])))
    return every.join(chosen, ["k", "leaf"], "left").join(solved, ["k", "node"], "left").select(F.col("k").alias(key), "leaf", "node", "gamma", "transform")
