"""A manifest of a data set as a Merkle tree, with proofs by parent preimages.

Each row is a leaf. Leaves of a source in the order of doc_id form runs of FANOUT; a
parent is the hash of its run's hashes, and its preimage, their concatenation, is
stored. So up to a subroot for each source; the subroots in the order of sources
form a tree likewise, up to the root.

A path of a leaf is the list of its ancestors' preimages with the slot that it, or its
ancestor, has in each. A slot is 64 characters: without it a preimage is the siblings,
with another hash in its place the preimage of a changed tree. Paths go down the
tree by joins of children with their parent, at most FANOUT to one: no key is hot,
and only rows of hashes are shuffled, never texts.

Order: rows are dealt to ranges of (source, doc_id, leaf) and numbered there; ranges before
are added. A source that holds most rows, or a doc_id that is repeated often, spans many
ranges, as do repeated rows, which a number of their own sets apart.

A null field is `-`; null sources form one source, the first; null ids are first in their
source. Rows that agree in doc_id are ordered by their leaf; repeated rows are leaves of
their own. An empty table gives an empty manifest. Further columns are not hashed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Children of a node, as a power of two; rows in a range.
FANOUT_BITS, RANGE_ROWS = 4, 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The hash of a row's fields, each with its length in bytes, so that no two rows have one preimage."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def hash_leaves(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and changed, the leaf with another text (null where that is null)."""
    own = leaf_hash([F.col(c) for c in FIELDS])
    other = F.lit(None).cast("string") if changed_text is None else F.when(changed_text.isNotNull(), leaf_hash([*[F.col(c) for c in FIELDS[:-1]], changed_text]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("leaf"), other.alias("changed"))


def number_leaves(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored leaves with tree (the source's place), idx (the leaf's place in its source), size (the source's leaves) and trees (sources)."""
    rows = leaves.withColumn("line", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranges = max(1, -(-leaves.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *order, F.col("line")).withColumn("range", F.spark_partition_id())
    dealt = scratch.put(dealt, "ranges")
    sizes = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    # a source begins in its first range; the sources that begin there follow each other in the order
    starts = sizes.groupBy("source").agg(F.min("range").alias("first"), F.sum("n").alias("size"))
    begun = starts.groupBy("first").agg(F.count(F.lit(1)).alias("new"))  # one row a range
    earlier = begun.select("first", (F.sum("new").over(Window.orderBy("first")) - F.col("new")).alias("earlier"), F.sum("new").over(Window.partitionBy()).alias("trees"))
    place = F.row_number().over(Window.partitionBy("first").orderBy(F.col("source").asc_nulls_first())) - 1
    named = starts.join(earlier, "first").select(F.col("source").alias("_source"), (F.col("earlier") + place).alias("tree"), "size", "trees")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    offsets = sizes.withColumn("before", before)
    offsets = offsets.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("range").alias("_range"), "before", "tree", "size", "trees")
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy(*order[1:]))
    joined = dealt.join(offsets, (F.col("range") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("tree", (F.col("before") + inside - 1).alias("idx"), "size", "trees", "doc_id", F.col("leaf").alias("hash"), "changed")


def _left(level: int, size: str = "size") -> Column:
    """Nodes of a tree of so many leaves at a level."""
    return F.expr(f"shiftright({size} + {(1 << FANOUT_BITS * level) - 1}L, {FANOUT_BITS * level})")


@dataclass
class Forest:
    """Trees by their levels: tree, idx, size, hash, and from level 1 on preimage."""

    levels: list[DataFrame]

    @classmethod
    def grow(cls, nodes: DataFrame, most: int, scratch: Scratch, name: str) -> Forest:
        """Parents of stored `nodes`, level by level until each tree has one node; each level is stored. The largest tree has `most` nodes."""
        levels = [nodes]
        while most > 1:
            level = len(levels)
            children = levels[-1].where(_left(level - 1) > 1)
            run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])  # at most FANOUT
            parents = children.groupBy("tree", "size", F.expr(f"shiftright(idx, {FANOUT_BITS})").alias("idx")).agg(F.array_join(run, "").alias("preimage"))
            levels.append(scratch.put(parents.withColumn("hash", F.sha2("preimage", 256)), f"{name}-{level}", keep=True))
            most = -(-most >> FANOUT_BITS)
        return cls(levels)

    def tops(self) -> DataFrame:
        """tree and hash of each tree's last node."""
        ends = [t.where(_left(k) == 1).select("tree", "hash") for k, t in enumerate(self.levels)]
        out = ends[0]
        for end in ends[1:]:
            out = out.union(end)
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with `path` and what else `tops` (tree, path, ...) tells of their tree.

        `path` is an array of (preimage, slot): a leaf's own tree from its parent up, then
        what `tops` has as path of the tree.
        """
        told = [c for c in tops.columns if c not in ("tree", "path")]
        slots = (1 << FANOUT_BITS) - 1
        above = None  # each level is read once, by the one below
        for level in range(len(self.levels) - 1, -1, -1):
            nodes = self.levels[level]
            own = [c for c in nodes.columns if c != "tree"]
            out = nodes.where(_left(level) == 1).join(tops, "tree").select("tree", *own, "path", *told)
            if above is not None:
                up = above.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *told)
                below = nodes.where(_left(level) > 1).withColumn("_up", F.expr(f"shiftright(idx, {FANOUT_BITS})"))
                step = F.array(F.struct(F.col("_preimage").alias("preimage"), F.col("idx").bitwiseAND(F.lit(slots)).cast("int").alias("slot")))
                joined = below.join(up, (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_idx")))
                out = out.union(joined.select("tree", *own, F.concat(step, "_path").alias("path"), *told))
            above = out
        return above


#: A slot taken out of a preimage, and another hash put into it.
SIBLINGS = "array_join(transform(path, p -> concat(substr(p.preimage, 1, 64 * p.slot), substr(p.preimage, 64 * p.slot + 65))), '')"
FOLDED = "aggregate(path, {leaf}, (h, p) -> sha2(concat(substr(p.preimage, 1, 64 * p.slot), h, substr(p.preimage, 64 * p.slot + 65)), 256))"
NO_PATH = "cast(array() as array<struct<preimage:string,slot:int>>)"


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, changed, subroot, root and path of each row of `docs`; `changed` is its leaf with `changed_text` as text."""
    scratch = Scratch(docs.sparkSession, "merkle")
    leaves = scratch.put(number_leaves(scratch.put(hash_leaves(docs, changed_text), "hashed"), scratch), "leaves", keep=True)
    most, trees = leaves.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("trees"), F.lit(0))).first()
    sources = Forest.grow(leaves, most, scratch, "source")
    subroots = sources.tops().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "hash")
    whole = Forest.grow(scratch.put(subroots, "subroots", keep=True), trees, scratch, "root")
    root = whole.tops().select("tree", F.expr(NO_PATH).alias("path"), F.col("hash").alias("root"))
    tops = whole.paths(root).select(F.col("idx").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    tops = scratch.put(tops, "tops", keep=True)
    found = sources.paths(tops).select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "root", "path")
    scratch.drop()
    return found


def proofs(found: DataFrame) -> DataFrame:
    """Manifest rows with proof_sha256, folded_root (from the changed leaf where there is one) and verified, without their paths."""
    start = "coalesce(changed, leaf)"
    folded = F.expr(FOLDED.format(leaf=start))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.expr(SIBLINGS), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
