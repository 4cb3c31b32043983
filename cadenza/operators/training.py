"""Training of hidden-state mixtures: rounds of expectation over transcripts' state chains, with sums that are stored.

An utterance is a chain of the states of its units, left to right with loops; a state's density is a mixture of
diagonal Gaussians. A round takes batches of utterances one by one. A batch's sums (occupancies and moments of Gaussians, transitions,
likelihoods) are written under the round's folder before the next batch begins, and a model is made from a round's
stored sums alone. So training goes on where it was stopped: rounds that have a model are over, batches that have sums are
passed over. Sums of batches may come from anywhere: `estimate` adds up what it is given.

An utterance that a beam loses is tried again with twice the beam, up to `most`; one that has fewer frames than
states, or no way even then, is counted as lost and gives nothing. The model, one row per Gaussian, travels to the
tasks; an utterance is held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import map_groups
from .statistics import TRANSITION_FLOOR, VARIANCE_FLOOR
from .storage import stored

#: Columns of a model: a state's number, its Gaussian's, and the probability to stay in the state.
MODEL = "state int, component int, weight double, mean array<double>, variance array<double>, stay double"
#: Columns of sums: kind g (a Gaussian: occupancy and moments), t (a state: first to stay, second to leave), u (all: log likelihood, frames; n utterances, lost).
SUMS = "kind string, state int, component int, n long, lost long, first double, second double, sum1 array<double>, sum2 array<double>"


@dataclass
class States:
    """A model in arrays: weights (states x components), means and variances (states x components x dim), stay (states)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    stay: np.ndarray

    @classmethod
    def of(cls, model: DataFrame) -> States:
        rows = sorted(model.select("state", "component", "weight", "mean", "variance", "stay").collect())  # a row per Gaussian
        n, m = rows[-1][0] + 1, max(r[1] for r in rows) + 1
        dim = len(rows[0][3])
        out = cls(np.zeros((n, m)), np.zeros((n, m, dim)), np.ones((n, m, dim)), np.full(n, 0.5))
        for state, k, weight, mean, variance, stay in rows:
            out.weights[state, k], out.means[state, k], out.variances[state, k], out.stay[state] = weight, mean, variance, stay
        return out

    def joint(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        """frames x states x components: the logarithm of weight times density."""
        inv = 1 / self.variances[states]
        means = self.means[states]
        const = -0.5 * (np.log(2 * np.pi * self.variances[states]).sum(-1) + (means**2 * inv).sum(-1))
        quad = -0.5 * np.einsum("td,skd->tsk", x**2, inv) + np.einsum("td,skd->tsk", x, means * inv)
        with np.errstate(divide="ignore"):
            return const + quad + np.log(self.weights[states])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def expect(x: np.ndarray, chain: np.ndarray, model: States, beam: float = np.inf) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """Log likelihood of all ways through a chain of states, posteriors (frames x states in the chain x components), and for each place
    in the chain how often it is stayed in and left; None if no way is left within the beam."""
    frames, places = len(x), len(chain)
    if frames < places:
        return None
    used, at = np.unique(chain, return_inverse=True)
    joint = model.joint(x, used)
    density = _log_sum(joint, 2)
    s = density[:, at]
    stay, leave = np.log(model.stay[chain]), np.log1p(-model.stay[chain])
    ahead = np.full((frames, places), -np.inf)
    ahead[0, 0] = s[0, 0]
    for t in range(1, frames):
        moved = np.concatenate([[-np.inf], ahead[t - 1, :-1] + leave[:-1]])
        ahead[t] = np.logaddexp(ahead[t - 1] + stay, moved) + s[t]
        ahead[t, ahead[t] < ahead[t].max() - beam] = -np.inf
    whole = ahead[-1, -1] + leave[-1]
    if not np.isfinite(whole):
        return None
    behind = np.full((frames, places), -np.inf)
    behind[-1, -1] = leave[-1]
    stayed, left = np.zeros(places), np.zeros(places)
    left[-1] = 1.0
    for t in range(frames - 2, -1, -1):
        here = stay + s[t + 1] + behind[t + 1]
        on = leave[:-1] + s[t + 1, 1:] + behind[t + 1, 1:]
        behind[t] = np.logaddexp(here, np.append(on, -np.inf))
        stayed += np.exp(ahead[t] + here - whole)
        left[:-1] += np.exp(ahead[t, :-1] + on - whole)
    gamma = np.exp(ahead + behind - whole)
    with np.errstate(invalid="ignore"):
        share = np.exp(joint - density[..., None])
    return float(whole), gamma[..., None] * np.nan_to_num(share)[:, at], stayed, left


def sums_of(frames: DataFrame, model: States, beam: float = np.inf, most: float = np.inf) -> DataFrame:
    """SUMS of utterances: frames (utt, frame, x) with the utterance's states in the column `chain` of its first frame."""
    sent = frames.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        model = sent.value
        x = np.asarray(table.column("x").combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        occupancy, first, second = np.zeros(model.weights.shape), np.zeros(model.means.shape), np.zeros(model.means.shape)
        moves, whole, n_frames, n, lost = np.zeros((len(model.stay), 2)), 0.0, 0, 0, 0
        chains = table.column("chain")
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            chain, width = np.array(chains[a].as_py() or [], np.int64), beam
            found = None
            while found is None and len(chain):
                found = expect(x[a:b], chain, model, width)
                if b - a < len(chain) or not np.isfinite(width) or 2 * width > most:
                    break
                width *= 2
            if found is None:
                lost += 1
                continue
            n, n_frames, whole = n + 1, n_frames + b - a, whole + found[0]
            gamma = found[1]
            np.add.at(occupancy, chain, gamma.sum(0))
            np.add.at(first, chain, np.einsum("tsk,td->skd", gamma, x[a:b]))
            np.add.at(second, chain, np.einsum("tsk,td->skd", gamma, x[a:b] ** 2))
            np.add.at(moves[:, 0], chain, found[2])
            np.add.at(moves[:, 1], chain, found[3])
        g, k = np.nonzero(occupancy)
        t = np.flatnonzero(moves.any(1))
        rows = [("g", int(i), int(j), 0, 0, float(occupancy[i, j]), 0.0, first[i, j].tolist(), second[i, j].tolist()) for i, j in zip(g, k, strict=True)]
        rows += [("t", int(i), 0, 0, 0, float(moves[i, 0]), float(moves[i, 1]), [], []) for i in t]
        rows.append(("u", 0, 0, n, lost, whole, float(n_frames), [], []))
        names = ("kind", "state", "component", "n", "lost", "first", "second", "sum1", "sum2")
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    rows = frames.select("utt", "frame", F.col("x").cast("array<double>").alias("x"), "chain")
    # tasks' sums, a few rows each, are read twice
    return add_sums(stored(map_groups(rows, "utt", ["frame"], run, SUMS)))


def add_sums(parts: DataFrame) -> DataFrame:
    """SUMS of tasks, batches or runs, added up: one row for each Gaussian, state and the whole."""
    keys = ["kind", "state", "component"]
    scalars = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "lost", "first", "second")])
    each = parts.where("size(sum1) > 0").select(*keys, F.posexplode(F.arrays_zip("sum1", "sum2")).alias("i", "s"))
    each = each.groupBy(*keys, "i").agg(F.sum("s.sum1").alias("a"), F.sum("s.sum2").alias("b"))
    vectors = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("v"))
    joined = scalars.join(vectors, keys, "left")
    empty = F.array().cast("array<double>")
    return joined.select(*keys, "n", "lost", "first", "second", F.coalesce(F.col("v.a"), empty).alias("sum1"), F.coalesce(F.col("v.b"), empty).alias("sum2"))


def estimate(sums: DataFrame, old: DataFrame, floor: float = VARIANCE_FLOOR) -> DataFrame:
    """The MODEL of greatest likelihood under added SUMS; a Gaussian without occupancy keeps its moments, a state without any all of its old self."""
    g = sums.where("kind = 'g'").select("state", "component", F.col("first").alias("occ"), "sum1", "sum2")
    t = sums.where("kind = 't'").select("state", F.col("first").alias("stays"), F.col("second").alias("leaves"))
    whole = g.groupBy("state").agg(F.sum("occ").alias("all"))
    rows = old.join(g, ["state", "component"], "left").join(whole, "state", "left").join(t, "state", "left")
    mean = F.when(F.col("occ") > 0, F.transform("sum1", lambda s: s / F.col("occ"))).otherwise(F.col("mean"))
    rows = rows.withColumn("new", mean)
    variance = F.when(F.col("occ") > 0, F.zip_with("sum2", "new", lambda s, m: F.greatest(s / F.col("occ") - m * m, F.lit(floor)))).otherwise(F.col("variance"))
    weight = F.when(F.col("all") > 0, F.coalesce("occ", F.lit(0.0)) / F.col("all")).otherwise(F.col("weight"))
    moves = F.col("stays") + F.col("leaves")
    stay = F.when(moves > 0, F.least(F.greatest(F.col("stays") / moves, F.lit(TRANSITION_FLOOR)), F.lit(1 - TRANSITION_FLOOR))).otherwise(F.col("stay"))
    return rows.select("state", "component", weight.alias("weight"), F.col("new").alias("mean"), variance.alias("variance"), stay.alias("stay"))


def with_chains(frames: DataFrame, transcripts: DataFrame, units: list[str], states: int = 3) -> DataFrame:
    """frames (utt, frame, x) with `chain` on each first frame: the states of the units of `transcripts` (utt, labels).

    State s of unit u has the number place(u) * states + s. An utterance with an unknown unit has no chain.
    """
    place = F.create_map(*[F.lit(v) for i, u in enumerate(units) for v in (u, i)])
    chain = F.flatten(F.transform("labels", lambda u: F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.element_at(place, u) * states + s)))
    known = F.forall("labels", lambda u: u.isin(units))
    first = transcripts.where(known).select("utt", F.lit(0).alias("frame"), chain.alias("chain"))
    return frames.join(first, ["utt", "frame"], "left")


class Training:
    """Rounds of training under a folder that all executors share; what is there already is not done again."""

    def __init__(self, spark: SparkSession, folder: str, batches: int = 20, beam: float = np.inf, most: float = np.inf) -> None:
        self.spark, self.folder, self.batches, self.beam, self.most = spark, folder.rstrip("/"), batches, beam, most

    def _is_there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _once(self, name: str, make) -> DataFrame:
        """The table of a name, made and written if it is not whole."""
        if not self._is_there(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run(self, frames: DataFrame, model: DataFrame, rounds: int) -> DataFrame:
        """The model after so many rounds. `frames` has chains; it is dealt to batches of utterances once, each of which is read alone."""
        if not self._is_there("frames"):
            batch = F.pmod(F.xxhash64("utt"), F.lit(self.batches)).cast("int")
            dealt = frames.select("utt", "frame", "x", "chain", batch.alias("batch"))
            dealt.write.mode("overwrite").partitionBy("batch").parquet(f"{self.folder}/frames")
        self._once("model-0", lambda: model.select(*[c.split()[0] for c in MODEL.split(", ")]))
        held = self.spark.read.parquet(f"{self.folder}/frames")
        for r in range(1, rounds + 1):
            if self._is_there(f"model-{r}"):
                continue
            old = self.spark.read.parquet(f"{self.folder}/model-{r - 1}")
            states = States.of(old)
            for b in range(self.batches):
                self._once(f"sums-{r}/{b}", lambda b=b, states=states: sums_of(held.where(F.col("batch") == b).drop("batch"), states, self.beam, self.most))
            self._once(f"model-{r}", lambda r=r, old=old: estimate(self.sums(r), old))
        return self.spark.read.parquet(f"{self.folder}/model-{rounds}")

    def sums(self, r: int) -> DataFrame:
        """The stored sums of a round's batches, added up."""
        return add_sums(self.spark.read.parquet(*[f"{self.folder}/sums-{r}/{b}" for b in range(self.batches)]))

    def history(self, rounds: int) -> DataFrame:
        """round, utterances, lost, frames and log_likelihood (before the round's update) of rounds that are over."""
        rows = None
        for r in range(1, rounds + 1):
            one = self.sums(r).where("kind = 'u'").select(F.lit(r).alias("round"), F.col("n").alias("utterances"), "lost", F.col("second").cast("long").alias("frames"), F.col("first").alias("log_likelihood"))
            rows = one if rows is None else rows.union(one)
        return rows
