"""Connected components of links that Spark holds, by alternating star contraction.

Each round replaces the links of a node by links to its least neighbour, first for
larger neighbours, then for smaller ones; in the end each node is linked to the
least node of its component. Minima are combined before they are shuffled, so a
node with very many links is no hot key there. Nodes that hold more than a
bounded share of all links are few: these meet their minima by a broadcast, so
no task gets all links of one node. Rounds grow with the logarithm of the longest chain. Each is stored in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_parts

#: A node is hot from so many links on, and from so great a share of all links: at most 2 * HOT_NODES are.
HOT_LINKS, HOT_NODES = 100_000, 2_000


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels of linked items agree, in place: each label is the least item of its group."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch without those that others imply."""
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = np.arange(len(names))
        join_labels(labels, at[: len(a)], at[len(a) :])
        child = np.flatnonzero(labels != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[labels[child]])], names=["u", "v"])


def _with_least(links: DataFrame, peak: int, total: int) -> DataFrame:
    """Links (u, v) with m, the least v of their u; `peak` is the most links that any node has, `total` the number of all."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = max(HOT_LINKS, -(-total // HOT_NODES))
    if peak < hot:
        return links.join(least.select("u", "m"), "u")
    few = F.broadcast(least.where(F.col("n") >= hot).select("u", F.col("m").alias("hot_m")))  # 2 * HOT_NODES rows at most
    known = links.join(few, "u", "left")
    rest = known.where("hot_m is null").select("u", "v").join(least.where(F.col("n") < hot).select("u", "m"), "u")
    return known.where("hot_m is not null").select("u", "v", F.col("hot_m").alias("m")).union(rest)


def connected_components(links: DataFrame, scratch: Scratch, forest: bool = False, about: int | None = None) -> DataFrame:
    """id and component_id (the least id reachable) of each node in `links`, whose two columns are long.

    `forest` says that tasks have already left out links that others imply; `about` how many
    links there are, roughly, where that is known.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    links = links if forest else links.mapInArrow(_forest, "u long, v long")
    mirrored = lambda t: t.union(t.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(t: DataFrame) -> tuple[int, int, int]:
        """Links, a digest of them, and the most links that a node has."""
        per = mirrored(t).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.least("u", "v"), F.greatest("u", "v"), F.col("u") < F.col("v"))).alias("x"))
        return tuple(per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.coalesce(F.max("n"), F.lit(0))).first())

    links = links.distinct()
    table = scratch.put(links if about is None else in_parts(links, about), "links-0")
    seen, turn = state(table), 0
    while True:
        both = _with_least(mirrored(table), seen[2], seen[0])
        up = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        kept = _with_least(up, seen[2], seen[0])
        table = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(kept.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        table = scratch.put(in_parts(table, seen[0]), f"links-{turn}")
        scratch.drop(f"links-{turn - 1}")
        now = state(table)
        if now == seen:
            break
        seen = now
    roots = table.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return table.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
