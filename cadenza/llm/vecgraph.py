"""Near-duplicates of vectors by a robust-pruned flat graph.

1. Equal vectors become one item with a count.
2. A bounded sample gives cluster centres; one within the link range of a larger one
   goes, so that a dense group stays in one cluster. Each item is a member of the OVERLAP
   nearest clusters; the first is its home. Large clusters are cut into parts.
3. In each part a graph is built: the nearest members and some far ones are
   candidates, which robust pruning thins to DEGREE neighbours.
4. The lists of all parts in which an item is a member are united.
5. Each item is searched in all parts of its home, in blocks of bounded size: a greedy
   search with a list of BEAM members starts from the medoid and, where the item is a
   member, from itself; whatever it meets within range is expanded until nothing within
   range is left, and an item with more than WIDE members in range is compared with the
   whole part. Links are verified in double precision. A link that only one end can find
   is credited to both.

Parts return counts and a forest of links, so a large group of near copies is not
emitted as pairs. The graph is approximate: `audit_recall` measures it against
brute force. A vector longer than another is compared as if that went on with zeros.

Vectors that are null or zero or hold null or non-finite components link with
nothing, not even equal ones. Rows with a null vec_id count as vectors but are
not the name of a component unless alone. Repeated rows are vectors that link. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_labels
from .pretokens import ragged, text_bytes
from .shared import Scratch, hash_share
from .vectors import matrix

LEAST_COSINE = 0.9
OVERLAP, DEGREE, CANDIDATES, FAR, ALPHA, BEAM, WEAK = 4, 16, 48, 8, 1.2, 12, 4
#: What single precision may be off by.
SLACK = 1e-5
#: Neighbours in a united list.
LIST = 6 * DEGREE
#: Members of a part; centres; vectors sampled for centres: so many at least, and for each centre.
PART, MOST_CENTRES, SAMPLE, PER_CENTRE = 1500, 16_384, 8192, 4
#: Members within range of an item from which it is compared with all; items searched for in a group.
WIDE, BLOCK = 32, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that tiny and huge ones neither vanish nor overflow."""
    top = np.abs(x).max(1, initial=0.0)[:, None]
    x = x / np.where(top > 0, top, 1.0)
    return x / np.maximum(np.sqrt((x * x).sum(1))[:, None], 1e-300)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, some vectors at once."""
    return np.concatenate([(v[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(v), 1024)]) if len(v) else np.zeros(0, np.int64)


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Directions of k clusters, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(4):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(full[:, None], unit(sums), centres)
    return centres


def apart(sample: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Centres of which none was within `least` of a larger one: that takes the others' vectors with its own."""
    mass = np.bincount(nearest(sample, centres), minlength=len(centres))
    left, out = np.ones(len(centres), bool), []
    for i in np.argsort(-mass, kind="stable"):
        if left[i]:
            near = left & (centres @ centres[i] >= least)
            near[i] = True
            out.append(np.maximum(mass[near], 1e-9) @ centres[near])
            left &= ~near
    return unit(np.array(out))


def prune(v: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates: neighbours by index, -1 where there are fewer."""
    n = len(v)
    if n < 2:
        return np.full((n, 1), -1)
    cos = v @ v.T
    np.fill_diagonal(cos, -2.0)
    c = min(CANDIDATES, n - 1)
    near = np.argpartition(-cos, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), 1), 1)
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    cand = np.concatenate([near, far], 1)
    gap = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(cos, cand, 1), 0))
    gap[cand == np.arange(n)[:, None]] = np.inf
    rows, out = np.arange(n), np.full((n, DEGREE), -1)
    alive = np.isfinite(gap)
    for r in range(DEGREE):
        left = np.where(alive, gap, np.inf)
        pick = left.argmin(1)
        some = np.isfinite(left[rows, pick])
        if not some.any():
            break
        star = cand[rows, pick]
        out[some, r] = star[some]
        between = np.sqrt(np.maximum(2 - 2 * cos[star[:, None], cand], 0))
        alive &= ~((ALPHA * between <= gap) & some[:, None])
        alive &= cand != star[:, None]
    return out


def search(v: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, medoid: int, least: float = LEAST_COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, member) within range that a greedy search with a beam meets, and their cosines in single precision.

    All queries go in step, each with a list of its BEAM best members: it expands the
    best one that it has not expanded, and any that is within range. A query with more
    than WIDE members in range is compared with all.
    """
    m, n = len(queries), len(v)
    v, queries = v.astype(np.float32), queries.astype(np.float32)
    seen, done = np.zeros((m, n), bool), np.zeros((m, n), bool)
    beam, score = np.full((m, BEAM), -1), np.full((m, BEAM), -2.0, np.float32)
    hits, whole = np.zeros(m, np.int64), np.zeros(m, bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """See members for the first time: into the beam with them. Those within range come back."""
        new = (p >= 0) & ~whole[q]
        q, p = q[new], p[new]
        q, p = q[~seen[q, p]], p[~seen[q, p]]
        q, p = np.divmod(np.unique(q * n + p), n)
        if not len(q):
            return q, p
        seen[q, p] = True
        s = np.empty(len(q), np.float32)
        for i in range(0, len(q), 100_000):  # bounds what is gathered at once
            s[i : i + 100_000] = np.einsum("ij,ij->i", queries[q[i : i + 100_000]], v[p[i : i + 100_000]])
        near = s >= least - SLACK
        found.append((q[near], p[near], s[near]))
        hits[:] += np.bincount(q[near], minlength=m)
        better = s > score[q, -1]
        who = np.unique(q[better])
        into = np.concatenate([np.repeat(who, BEAM), q[better]])
        ids, value = np.concatenate([beam[who].ravel(), p[better]]), np.concatenate([score[who].ravel(), s[better]])
        order = np.lexsort((-value, into))
        into, ids, value = into[order], ids[order], value[order]
        place = np.arange(len(into)) - np.searchsorted(into, into)
        kept = place < BEAM
        beam[into[kept], place[kept]], score[into[kept], place[kept]] = ids[kept], value[kept]
        return q[near], p[near]

    def expand(q: np.ndarray, p: np.ndarray) -> None:
        """Expand members, then all within range that this brings, until there are no more."""
        while len(q):
            done[q, p] = True
            q, p = visit(np.repeat(q, graph.shape[1]), graph[p].ravel())
            wide = np.flatnonzero((hits > WIDE) & ~whole)
            if len(wide):
                whole[wide] = True
                a, b = np.nonzero((every := queries[wide] @ v.T) >= least - SLACK)
                found.append((wide[a], b, every[a, b]))
            going = ~whole[q] & ~done[q, p]
            q, p = q[going], p[going]

    rows = np.arange(m)
    visit(rows, np.full(m, medoid))
    visit(rows[own >= 0], own[own >= 0])
    active = rows
    while len(active):
        known = beam[active]
        fresh = np.where((known >= 0) & ~done[active[:, None], known], score[active], -3.0)
        best = fresh.argmax(1)
        going = (fresh[np.arange(len(active)), best] > -3.0) & ~whole[active]
        active, chosen = active[going], known[going, best[going]]
        expand(active, chosen)
    q, p, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    # one that was compared with all has met some members before
    _, once = np.unique(q * n + p, return_index=True)
    return q[once], p[once], s[once]


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row; `vectors` has vec_id and embedding."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vecgraph")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = matrix(batch.column("embedding"))
            whole &= (x != 0).any(1) if x.shape[1] else False
            x = unit(np.where(whole[:, None], x, 1.0)) if x.shape[1] else x
            size = np.where(x.any(1), x.shape[1] - (x[:, ::-1] != 0).argmax(1), 0) if x.shape[1] else np.zeros(len(x), int)
            key = [r[:s].tobytes() if ok else None for r, s, ok in zip(x + 0.0, size.tolist(), whole.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.binary())], names=["vec_id", "v"])

    known = scratch.put(rows.mapInArrow(read, "vec_id long, v binary"), "known", keep=True)
    items = known.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    items = scratch.put(items.select(F.monotonically_increasing_id().alias("item"), F.sha2("v", 256).alias("sha"), "v", "least_id", "copies"), "items", keep=True)
    count, longest = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    width = longest // 8

    def table(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Vectors as rows, shorter ones filled with zeros."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        data, offsets = text_bytes(column)
        size = np.diff(offsets) // 8
        out = np.zeros((len(column), width))
        out[np.repeat(np.arange(len(column)), size), ragged(np.zeros(len(column), np.int64), size)] = np.frombuffer(data.tobytes(), np.float64)
        return out

    wanted = min(MOST_CENTRES, max(1, -(-OVERLAP * count // PART)))
    chosen = items.where(hash_share("item") < max(SAMPLE, PER_CENTRE * wanted) / max(1, count))  # some 65,536 at most
    sample = table(chosen.orderBy("item").select("v").toArrow().column("v"))
    centres = apart(sample, centres_of(sample, wanted), least) if len(sample) else np.zeros((0, width))
    overlap = min(OVERLAP, len(centres))
    sent = spark.sparkContext.broadcast(centres)  # MOST_CENTRES at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = table(batch.column("v")) @ sent.value.T
            near = np.argpartition(-cos, overlap - 1, axis=1)[:, :overlap]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), 1, "stable"), 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, max(1, overlap), dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "v", "copies")), lists], names=["item", "v", "copies", "clusters"])

    placed = scratch.put(items.mapInArrow(assign, "item long, v binary, copies long, clusters array<int>"), "placed")
    sizes = {r[0]: -(-r[1] // (2 * PART)) for r in placed.select(F.explode("clusters").alias("c")).groupBy("c").count().collect()}  # MOST_CENTRES at most
    home = F.element_at("clusters", 1)
    asking = {r[0]: -(-r[1] // BLOCK) for r in placed.groupBy(home.alias("c")).count().collect()}  # MOST_CENTRES at most
    table_of = lambda d: F.create_map(*[F.lit(x) for c, p in sorted(d.items()) for x in (c, p)]) if d else F.create_map(F.lit(0), F.lit(1))
    parts, blocks = table_of(sizes), table_of(asking)
    members = placed.select("*", F.explode("clusters").alias("cluster")).withColumn("part", F.pmod(F.xxhash64("item", "cluster"), F.element_at(parts, F.col("cluster"))).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("item"))
        graph = prune(table(group.column("v")))
        a, k = np.nonzero(graph >= 0)
        # a node that few chose must be met through its own nearest neighbours
        weak = np.bincount(graph[a, k], minlength=len(ids)) < WEAK
        back = np.concatenate([np.zeros(len(a), np.int64), np.where(weak[a] & (k < WEAK), 0, 1)])
        return pa.table({"a": np.concatenate([ids[a], ids[graph[a, k]]]), "back": back, "b": np.concatenate([ids[graph[a, k]], ids[a]])})

    # both directions of each edge, of those that others chose a bounded number; a list is at most as long as the parts are large
    edges = members.groupBy("cluster", "part").applyInArrow(build, "a long, back long, b long")
    # by a hash of the edge, so that no node is the last in all lists
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("back", F.xxhash64("a", "b").alias("by"), "b"))), lambda x: x["b"])
    united = edges.groupBy("a").agg(F.slice(F.array_distinct(chosen), 1, LIST).alias("neighbours"))
    united = scratch.put(united.withColumnRenamed("a", "item"), "graph")
    nodes = members.join(united, "item", "left").select("cluster", "part", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cluster")) - 1)).alias("block"), "item", "v", "copies", "clusters", "neighbours", F.lit(True).alias("member"))
    asked = placed.withColumn("cluster", home).select("cluster", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("cluster")) - 1)).alias("part"), F.pmod(F.xxhash64("item", F.lit("block")), F.element_at(blocks, F.col("cluster"))).cast("int").alias("block"), "item", "v", "copies", "clusters", F.lit(None).cast("array<long>").alias("neighbours"), F.lit(False).alias("member"))

    def find(group: pa.Table) -> pa.Table:
        member = np.asarray(group.column("member"))
        nodes, asks = group.filter(pa.array(member)), group.filter(pa.array(~member))
        empty = pa.table({"item": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not len(nodes) or not len(asks):
            return empty
        v, q = table(nodes.column("v")), table(asks.column("v"))
        ids, asked_ids = np.asarray(nodes.column("item")), np.asarray(asks.column("item"))
        order = np.argsort(ids)
        lists = nodes.column("neighbours").to_pylist()
        graph = np.full((len(ids), LIST), -1)
        for i, near in enumerate(lists):
            if near:
                at = np.searchsorted(ids[order], near)
                at = order[np.minimum(at, len(ids) - 1)]
                graph[i, : len(near)] = np.where(ids[at] == np.array(near), at, -1)
        at = order[np.minimum(np.searchsorted(ids[order], asked_ids), len(ids) - 1)]
        own = np.where(ids[at] == asked_ids, at, -1)
        medoid = int((v @ v.mean(0)).argmax())
        cluster = group.column("cluster")[0].as_py()
        first = np.array([c[0] for c in nodes.column("clusters").to_pylist()])
        lists_q = np.array(asks.column("clusters").to_pylist())
        copies, copies_q = np.asarray(nodes.column("copies")), np.asarray(asks.column("copies"))
        found = {"item": [], "links": [], "to": []}
        labels = np.arange(len(ids) + len(asked_ids))
        credit, credit_q = np.zeros(len(ids), np.int64), np.zeros(len(asked_ids), np.int64)
        for i in range(0, len(asked_ids), 512):
            a, b, exact = search(v, graph, q[i : i + 512], own[i : i + 512], medoid, least)
            exact = exact.astype(float)
            near = np.flatnonzero(np.abs(exact - least) < 2 * SLACK)  # the others are clear in single precision too
            for j in range(0, len(near), 100_000):
                at = near[j : j + 100_000]
                exact[at] = np.einsum("ij,ij->i", q[i + a[at]], v[b[at]])
            a, b = a[(exact >= least) & (ids[b] != asked_ids[i + a])] + i, b[(exact >= least) & (ids[b] != asked_ids[i + a])]
            np.add.at(credit_q, a, copies[b])
            # the other end is at home elsewhere, where this one is no member
            one_way = ~(lists_q[a] == first[b][:, None]).any(1)
            np.add.at(credit, b[one_way], copies_q[a[one_way]])
            join_labels(labels, b, len(ids) + a)
        for x, n in ((ids, credit), (asked_ids, credit_q)):
            some = np.flatnonzero(n)
            found["item"].append(x[some]), found["links"].append(n[some]), found["to"].append(x[some])
        both = np.concatenate([ids, asked_ids])
        child = np.flatnonzero(both != both[labels])
        found["item"].append(both[child]), found["links"].append(np.zeros(len(child), np.int64)), found["to"].append(both[labels[child]])
        # an item asked for here and its node are one
        return pa.table({k: np.concatenate(x) for k, x in found.items()})

    links = scratch.put(nodes.union(asked).groupBy("cluster", "part", "block").applyInArrow(find, "item long, links long, to long"), "links", keep=True)
    counts = links.groupBy("item").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select("item", "to"), scratch, forest=True).select(F.col("id").alias("item"), F.col("component_id").alias("root"))
    named = items.join(counts, "item", "left").join(groups, "item", "left").withColumns({"links": F.coalesce("links", F.lit(0).cast("long")), "root": F.coalesce("root", "item")})
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.put(named.join(roots, "root").select("sha", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named", keep=True)
    scratch.drop()
    out = known.withColumn("sha", F.sha2("v", 256)).join(named, "sha", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, result: DataFrame, queries: int = 256, least: float = LEAST_COSINE) -> tuple[int, int]:
    """Links counted by `result` and by brute force for a bounded sample of vectors, by hash of vec_id."""
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where(hash_share("vec_id") < queries / max(1, rows.count())).collect()
    ids, x = [r[0] for r in asked], pa.array([r[1] for r in asked], pa.list_(pa.float64()))
    q, whole = matrix(x)
    q = unit(np.where(whole[:, None], q, 0.0))
    sent = vectors.sparkSession.sparkContext.broadcast(q)  # `queries` vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            v, ok = matrix(batch.column("embedding"))
            if v.shape[1]:
                d = max(v.shape[1], sent.value.shape[1])
                grow = lambda m: np.pad(m, ((0, 0), (0, d - m.shape[1])))
                total += (grow(sent.value) @ grow(unit(np.where(ok[:, None], v, 0.0))).T >= least).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["q", "n"])

    true = {ids[r[0]]: r[1] - 1 for r in rows.mapInArrow(count, "q long, n long").groupBy("q").agg(F.sum("n")).collect()}
    found = {r[0]: r[1] for r in result.where(F.col("vec_id").isin(ids)).select("vec_id", "n_links").collect()}
    return sum(min(found.get(i, 0), max(0, n)) for i, n in true.items()), sum(max(0, n) for n in true.values())
