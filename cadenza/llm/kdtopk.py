"""Exact top-k by integer inner product, with a KD-tree in each shard.

Components become floor(64 x). Rows are dealt to shards of bounded size by a hash. In
each shard a KD-tree is planted once: medians of the widest component divide the rows
down to leaves, and each node has a tight bounding box. The trees are stored.

Queries go in blocks of bounded size, which are broadcast. In a tree each query goes
best first: of the nodes that it knows it takes the one whose box has the largest
possible inner product with it, opens that one's children or scores its leaf, and
stops when no box reaches its kth best score so far. That score is handed on from tree to
tree within a task, and from a first round over some of the shards to a second one over
the others. No candidate is shuffled after the trees are planted.

The best k of each task are merged by a window over queries. The work is that of the
stated queries against all rows, less what the bounds save.

Vectors that are null or hold null or non-finite components take no part, nor do rows
with a null vec_id. Shorter vectors go on with zeros. Rows that repeat a vec_id are
rows of their own: each is a candidate for all others, and a query if its vec_id
says so. Ties go to smaller vec_ids. Scores beyond 2**53 are computed exactly and
limited to the range of a long. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .vectors import matrix

SCALE, K = 64, 20
#: Rows in a leaf and a shard; queries in a block and in a walk; of so many shards one is in the first round.
LEAF, SHARD, BLOCK, WALK, FIRST = 256, 16_384, 65_536, 4096, 16
#: Up to this sum of absolute products doubles add integers exactly.
EXACT = float(1 << 53)
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def to_integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


@dataclass
class Tree:
    """Rows in the order of the leaves; of each node its box, its rows (begin, end) and its first child, whose sister is next (0: a leaf)."""

    x: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = np.int32 if np.abs(self.x).max(initial=0) < 1 << 31 else np.float64
        np.savez(out, **{**vars(self), "x": self.x.astype(small)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as parts:
            found = {name: parts[name] for name in parts.files}
        return cls(**{**found, "x": found["x"].astype(np.float64)})


def plant(x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> Tree:
    """A KD-tree: medians of the widest component divide the rows, until a leaf holds LEAF or all of them are equal."""
    order = np.arange(len(x))
    begin, end, child, todo = [0], [len(x)], [0], [0]
    while todo:
        node = todo.pop()
        here = order[begin[node] : end[node]]
        spread = np.ptp(x[here], axis=0) if x.shape[1] else np.zeros(1)
        if len(here) <= LEAF or not spread.any():
            continue
        half = len(here) // 2
        order[begin[node] : end[node]] = here[np.argpartition(x[here, spread.argmax()], half)]
        child[node] = len(begin)
        begin += [begin[node], begin[node] + half]
        end += [begin[node] + half, end[node]]
        child += [0, 0]
        todo += [child[node], child[node] + 1]
    x = x[order]
    low = np.array([x[a:b].min(0) for a, b in zip(begin, end, strict=True)])
    high = np.array([x[a:b].max(0) for a, b in zip(begin, end, strict=True)])
    return Tree(x, rows[order], ids[order], low, high, np.array(begin), np.array(end), np.array(child))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exactly: in doubles where these are exact, else in Python's integers, as long."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object).dot(np.array([[int(v) for v in r] for r in x], object).T)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have with a point of a box, and a little more in case that is not exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
        most += np.abs(most) * 1e-9
    return np.nan_to_num(most, nan=np.inf, posinf=np.inf, neginf=-1e308)


@dataclass
class Best:
    """The best k scores of each query and their vec_ids, best first; `least` is a score that its kth best is known to reach."""

    scores: np.ndarray
    ids: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, bound: np.ndarray, k: int) -> Best:
        return cls(np.full((len(bound), k), NONE), np.full((len(bound), k), LAST), np.where(bound == NONE, -np.inf, bound.astype(np.float64)))

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge found rows: query, vec_id and score of each."""
        if not len(query):
            return
        k = self.scores.shape[1]
        hit = np.unique(query)
        query = np.concatenate([query, np.repeat(hit, k)])
        ids, scores = np.concatenate([ids, self.ids[hit].ravel()]), np.concatenate([scores, self.scores[hit].ravel()])
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < k
        self.scores[query[kept], place[kept]], self.ids[query[kept], place[kept]] = scores[kept], ids[kept]
        full = self.ids[hit, -1] != LAST
        self.least[hit] = np.where(full, np.maximum(self.least[hit], self.scores[hit, -1]), self.least[hit])


def walk(tree: Tree, q: np.ndarray, q_rows: np.ndarray, best: Best, at: int) -> None:
    """Take queries, whose places in `best` begin at `at`, through a tree, each in its own order."""
    bound = np.full((len(q), len(tree.begin)), -np.inf)  # of the nodes that a query knows and has not opened
    bound[:, 0] = reach(q, tree.low[0], tree.high[0])
    active = np.arange(len(q))
    while len(active):
        known = bound[active]
        node = known.argmax(1)
        top = known[np.arange(len(active)), node]
        going = (top > -np.inf) & (top >= best.least[at + active])
        active, node = active[going], node[going]
        bound[active, node] = -np.inf
        found: list[tuple] = []
        by = np.argsort(node, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else []:
            who, n = active[group], node[group[0]]
            if tree.child[n]:
                for c in (tree.child[n], tree.child[n] + 1):
                    bound[who, c] = reach(q[who], tree.low[c], tree.high[c])
                continue
            here = slice(tree.begin[n], tree.end[n])
            score = products(q[who], tree.x[here])
            a, b = np.nonzero((score >= best.least[at + who][:, None]) & (tree.rows[here][None] != q_rows[who][:, None]))
            found.append((at + who[a], tree.ids[here][b], score[a, b]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, d - a.shape[1]))), np.pad(b, ((0, 0), (0, d - b.shape[1])))


def _search(trees: DataFrame, q: np.ndarray, q_rows: np.ndarray, bound: np.ndarray, k: int) -> DataFrame:
    """row (of the query), vec_id, score: the best k of each query in each task; `q` has BLOCK queries at most."""
    sent = trees.sparkSession.sparkContext.broadcast((q, q_rows, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_rows, bound = sent.value
        best = Best.of(bound, k)
        for batch in batches:
            for raw in batch.column("tree"):
                tree = Tree.load(raw.as_py())
                for i in range(0, len(q), WALK):
                    x, part = tree.x, q[i : i + WALK]
                    if x.shape[1] != part.shape[1]:
                        part, tree.x = _same_width(part, x)
                        _, tree.low = _same_width(part, tree.low)
                        _, tree.high = _same_width(part, tree.high)
                    walk(tree, part, q_rows[i : i + WALK], best, i)
        a, b = np.nonzero(best.ids != LAST)
        for i in range(0, len(a), 100_000):
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(q_rows[x]), pa.array(best.ids[x, y]), pa.array(best.scores[x, y])], names=["row", "vec_id", "score"])

    return trees.select("tree").mapInArrow(run, "row long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other rows for each row whose vec_id `every` divides."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kdtopk")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = matrix(batch.column("x"))
            whole &= np.isfinite(to_integers(x)).all(1)
            yield batch.filter(pa.array(whole))

    # numbered once and stored: a row's number is its name
    items = scratch.put(rows.mapInArrow(clean, "vec_id long, x array<double>").withColumn("row", F.monotonically_increasing_id()), "items")
    query = F.col("vec_id") % every == 0
    n, asked = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(query.cast("long")), F.lit(0))).first()
    shards, blocks = -(-n // SHARD), -(-asked // BLOCK)
    shards = max(1, shards, min(12, n // (8 * LEAF)))  # some more where there are few
    part = F.xxhash64("row")

    def grow(group: pa.Table) -> pa.Table:
        tree = plant(to_integers(matrix(group.column("x"))[0]), np.asarray(group.column("row")), np.asarray(group.column("vec_id")))
        return pa.table({"shard": group.column("shard").slice(0, 1), "tree": pa.array([tree.dump()], pa.binary())})

    dealt = items.withColumn("shard", F.pmod(part, F.lit(shards)).cast("int"))
    trees = dealt.groupBy("shard").applyInArrow(grow, "shard int, tree binary")
    trees = scratch.put(trees.repartition(min(shards, 4096), "shard"), "trees")
    queries = items.where(query).withColumn("block", F.pmod(F.shiftright(part, 20), F.lit(max(1, blocks))))
    first = F.col("shard") % FIRST == 0
    found = []
    for block in range(blocks):
        here = queries.where(F.col("block") == block).select("row", "x").toArrow()  # BLOCK queries, give or take
        q, q_rows = to_integers(matrix(here.column("x"))[0]), np.asarray(here.column("row"))
        order = np.argsort(q_rows)
        q, q_rows = q[order], q_rows[order]
        bound = np.full(len(q), NONE)
        some = scratch.put(_search(trees.where(first), q, q_rows, bound, k), f"found-{block}-0", keep=True)
        # the kth best so far, of this block's queries
        kth = some.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).where(F.col("n") == k).select("row", "score").toArrow()
        bound[np.searchsorted(q_rows, np.asarray(kth.column("row")))] = np.asarray(kth.column("score"))
        found += [some, scratch.put(_search(trees.where(~first), q, q_rows, bound, k), f"found-{block}-1", keep=True)]
    names = scratch.put(queries.select("row", F.col("vec_id").alias("query_id")), "names", keep=True)
    scratch.drop()
    if not found:
        return names.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).limit(0)
    every_found = found[0]
    for more in found[1:]:
        every_found = every_found.union(more)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = every_found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "row").select("query_id", "rank", "vec_id", "score")
