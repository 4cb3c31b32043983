"""Near-duplicates by SimHash, found with vantage-point trees.

A fingerprint has a bit set if more than half of the 64-bit hashes of the text's
shingles have it set. Two fingerprints that differ in at most three bits differ in
at most one bit in one of their halves. So a tree of vantage points is kept for
each half, in which Hamming distance to a vantage point splits the fingerprints at
the median and the triangle inequality with a radius of one bit says which sides a
fingerprint can have partners in. Whole fingerprints are compared at the leaves:
the pairs are exact. Fingerprints of a shard that all agree in the tree's half are split by the other
half, in which partners may differ in three bits.

The upper levels of each tree come from a bounded sample and deal the distinct
fingerprints to shards; a fingerprint whose ball crosses a boundary is also sent to
the inner side as a visitor. In its shard the tree goes on until few comparisons
are left. Shards return a forest of links, never all pairs, so a large group of
near copies stays linear. Components are then formed over the shards' links.

Documents with one fingerprint are one item from the start. Nulls, empty texts and
texts of white space have fingerprint zero. A null doc_id is never the name of a
component unless all of its members are null. Repeated rows each get their row.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_labels
from .shared import PART_BYTES, Scratch, digest, fresh, hash_share, in_parts, map_text

SEED, SHINGLE, LINKED = 42, 3, 3
#: Fingerprints in a shard; fingerprints sampled for the upper levels, 16 for each shard at least: beyond
#: SAMPLE / 16 * SHARD distinct fingerprints (some 1.3 billion) shards grow.
SHARD, SAMPLE = 20_000, 1 << 20
#: Shingles hashed at once: their places are Python numbers meanwhile.
HASHED = 100_000
#: Comparisons done at once.
CELLS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of texts, as unsigned 64-bit integers."""
    import xxhash

    from .pretokens import text_bytes

    data, offsets = text_bytes(column)
    n = len(data)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not n:
        return out
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    begin = word & np.concatenate([[True], space[:-1]]) | word & edge[:n]
    close = word & (np.concatenate([space[1:], [True]]) | edge[1:])
    # one space after a word stays, other white space goes
    keep = word | (np.concatenate([[False], word[:-1]]) & ~edge[:n])
    raw = _LOWER[data[keep]].tobytes()
    place = np.cumsum(keep) - 1
    first, last = np.flatnonzero(begin), np.flatnonzero(close)
    of_text = np.searchsorted(first, offsets)
    counts = np.diff(of_text)
    shingles = np.where(counts, np.maximum(counts - shingle + 1, 1), 0)
    from .pretokens import ragged

    left = ragged(of_text[:-1], shingles)
    right = np.minimum(left + shingle - 1, np.repeat(of_text[1:] - 1, shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(left), np.uint64)
    for i in range(0, len(left), HASHED):
        a, b = place[first[left[i : i + HASHED]]].tolist(), (place[last[right[i : i + HASHED]]] + 1).tolist()
        hashes[i : i + HASHED] = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
    full = np.flatnonzero(shingles)
    at = np.concatenate([[0], np.cumsum(shingles[full])])
    # counts in lanes of 16 bits: long texts are summed in parts
    parts = np.unique(np.concatenate([at[:-1], *[np.arange(a, b, 65_535) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 65_535]]))
    owner = np.searchsorted(at, parts, side="right") - 1
    lanes, lane = np.uint64(0x0001000100010001), np.uint64(0xFFFF)
    need = shingles[full] // 2
    bits = np.zeros(len(full), np.uint64)
    for i in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(i)) & lanes, parts) if len(parts) else np.zeros(0, np.uint64)
        for j in range(4):
            total = np.bincount(owner, ((sums >> np.uint64(16 * j)) & lane).astype(np.float64), len(full))
            bits |= (total > need).astype(np.uint64) << np.uint64(16 * j + i)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """doc_id, fp (a signed long) of each text, and `row` and the text's size in bytes, if a row is given."""
    more = {} if row is None else {"row": row, "size": F.octet_length("text").cast("long")}
    rest = list(more)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array(fingerprints_of(batch.column("text"), shingle).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, *map(batch.column, rest)], names=["doc_id", "fp", *rest])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(v.alias(c) for c, v in more.items())), run, "doc_id long, fp long" + ", row binary, size long" * bool(rest))


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) if half else (fp & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def _split(keys: np.ndarray, rng: np.random.Generator) -> tuple[np.uint32, int] | None:
    """A vantage point and a distance that divide `keys` evenly with few near the boundary, or None if all are at one distance."""
    best = None
    some = keys if len(keys) <= 512 else rng.choice(keys, 512)
    for v in rng.choice(some, min(6, len(some)), replace=False):
        d = np.bitwise_count(some ^ v)
        for m in {int(np.median(d)), int(np.median(d)) - 1}:
            inner, near = np.mean(d <= m), np.mean((d == m) | (d == m + 1))
            if 0.05 < inner < 0.95:
                cost = near + abs(inner - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, v, m)
    return None if best is None else (best[1], best[2])


class Router:
    """The upper levels of a tree over one half."""

    def __init__(self, keys: np.ndarray, shards: int) -> None:
        self.nodes: list[tuple] = []
        self.shards = 0
        self._grow(keys, max(1, shards), np.random.default_rng(SEED))

    def _grow(self, keys: np.ndarray, shards: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        cut = _split(keys, rng) if shards > 1 and len(keys) >= 16 else None
        if cut is None:
            self.nodes.append((None, 0, self.shards, 0))
            self.shards += 1
            return at
        self.nodes.append(())
        inner = np.bitwise_count(keys ^ cut[0]) <= cut[1]
        left = self._grow(keys[inner], shards // 2, rng)
        self.nodes[at] = (*cut, left, self._grow(keys[~inner], shards - shards // 2, rng))
        return at

    def route(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, shard and whether it is at home there, for all shards in which it must be seen."""
        out = []
        todo = [(0, np.arange(len(keys)), np.zeros(0, np.int64))]
        while todo:
            node, home, visit = todo.pop()
            v, m, left, right = self.nodes[node]
            if v is None:
                out.append((home, np.full(len(home), left), np.ones(len(home), bool)))
                out.append((visit, np.full(len(visit), left), np.zeros(len(visit), bool)))
                continue
            d, e = np.bitwise_count(keys[home] ^ v).astype(np.int64), np.bitwise_count(keys[visit] ^ v).astype(np.int64)
            inner = d <= m
            crossing = ~inner & (d - 1 <= m)  # pairs over a boundary are found on its inner side
            todo.append((left, home[inner], np.concatenate([home[crossing], visit[e - 1 <= m]])))
            todo.append((right, home[~inner], visit[e + 1 > m]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Shard:
    """Links among fingerprints, kept as labels."""

    def __init__(self, fps: np.ndarray, half: int) -> None:
        self.fps, self.keys, self.others, self.labels = fps, _half(fps, half), _half(fps, 1 - half), np.arange(len(fps))
        self.rng = np.random.default_rng(SEED)

    def halves(self, p: np.ndarray, radius: int) -> tuple[np.ndarray, int, tuple | None]:
        """The half by which `p` can be split, how far partners can be apart there, and the split. Where all agree in the tree's own half, the other one may differ in all bits."""
        cut = _split(self.keys[p], self.rng)
        if cut is not None:
            return self.keys, radius, cut
        return self.others, LINKED, _split(self.others[p], self.rng)

    def compare(self, p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(q)))
        for i in range(0, len(p), step):
            rows = p[i : i + step]
            a, b = np.nonzero(np.bitwise_count(self.fps[rows][:, None] ^ self.fps[q][None]) <= LINKED)
            a, b = rows[a], q[b]
            apart = self.labels[a] != self.labels[b]
            join_labels(self.labels, a[apart], b[apart])

    def within(self, p: np.ndarray) -> None:
        """Link all pairs in `p`."""
        todo = [p]
        while todo:
            p = todo.pop()
            keys, radius, cut = self.halves(p, 1) if len(p) ** 2 > CELLS else (None, 0, None)
            if cut is None:
                self.compare(p, p)
                continue
            d = np.bitwise_count(keys[p] ^ cut[0]).astype(np.int64)
            inner = d <= cut[1]
            todo += [p[inner], p[~inner]]
            self.across(p[inner], p[~inner & (d - radius <= cut[1])])

    def across(self, p: np.ndarray, q: np.ndarray) -> None:
        """Link all pairs between `p` and `q`."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if not len(p) or not len(q):
                continue
            keys, radius, cut = self.halves(p, 1) if len(p) * len(q) > CELLS else (None, 0, None)
            if cut is None:
                self.compare(p, q)
                continue
            d, e = np.bitwise_count(keys[p] ^ cut[0]).astype(np.int64), np.bitwise_count(keys[q] ^ cut[0]).astype(np.int64)
            inner = d <= cut[1]
            todo += [(p[inner], q[e - radius <= cut[1]]), (p[~inner], q[e + radius > cut[1]])]


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """A forest of links (a, b) that joins all of `distinct` (fp, id) within LINKED bits, through chains of such links."""
    n = distinct.count()
    sample = distinct.select("fp").where(hash_share("fp") < SAMPLE / max(1, n)).toArrow().column("fp")
    keys = np.sort(np.asarray(sample)).astype(np.int64).view(np.uint64)
    routers = [Router(_half(keys, half), min(-(-n // SHARD), SAMPLE // 16)) for half in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, ids = np.asarray(batch.column("fp")), np.asarray(batch.column("id"))
            for half, router in enumerate(routers):
                item, shard, home = router.route(_half(fp.view(np.uint64), half))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), half, np.int32)), pa.array(shard.astype(np.int32)), pa.array(home), pa.array(fp[item]), pa.array(ids[item])], names=["half", "shard", "home", "fp", "id"])

    def link(table: pa.Table) -> pa.Table:
        fps, ids = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("id"))
        home = np.asarray(table.column("home"))
        order = np.argsort(ids, kind="stable")
        fps, ids, home = fps[order], ids[order], home[order]
        shard = _Shard(fps, table.column("half")[0].as_py())
        shard.within(np.flatnonzero(home))
        shard.across(np.flatnonzero(home), np.flatnonzero(~home))
        child = np.flatnonzero(shard.labels != np.arange(len(ids)))
        return pa.table({"a": ids[child], "b": ids[shard.labels[child]]})

    dealt = distinct.select("fp", "id").mapInArrow(deal, "half int, shard int, home boolean, fp long, id long")
    return dealt.groupBy("half", "shard").applyInArrow(link, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of each row of `docs`, and `row` and size, if a row is given; fp, root (a fingerprint that names the component), component_id of each fingerprint."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, shingle, row), "prints", keep=True)
    distinct = scratch.put(in_parts(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), prints.count()), "distinct", keep=True)
    n = distinct.count()
    # items are linked by fingerprint: two may share a doc_id, and it may be null
    links = fingerprint_links(distinct.select("fp", F.col("fp").alias("id")))
    groups = connected_components(links, scratch, forest=True, about=2 * n)  # a fingerprint is in a tree for each half
    named = distinct.join(groups.select(F.col("id").alias("fp"), F.col("component_id").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("id").alias("component_id"))
    names = scratch.put(in_parts(named.join(roots, "root").select("fp", "root", "component_id"), n), "names", keep=True)
    scratch.drop()
    return prints, names


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of `docs`."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    prints, names = _grouped(docs, shingle)
    return prints.join(names, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with all columns: of those with the least doc_id, nulls last, the one with the least digest of all its columns.

    Rows that agree in all columns are one before they meet what was chosen: they are combined in their
    tasks first, so one row that is repeated very often is no hot key. So the result is the same however rows are dealt.
    """
    every = digest(*[f"`{c}`" for c in docs.columns])
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    key = fresh("_kept", docs)
    prints, names = _grouped(docs, shingle, every)
    kept = prints.join(names, "fp").groupBy("root").agg(best.alias("best")).select(F.col("best.row").alias(key))
    # by a merge at every size: it uses the partitions and the order of the rows that were made one
    rows = docs.withColumn(key, every).dropDuplicates([key]).join(kept.hint("merge"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
    return in_parts(rows, prints.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], PART_BYTES)
