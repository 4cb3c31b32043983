"""Networks of units and words as tables of arcs, and searches over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .storage import stored

#: Rows of counted tables that are broadcast.
FEW = 10_000


def transcript_network(words: DataFrame, key: str, order: str, word: str, lexicon: DataFrame) -> DataFrame:
    """key, src, dst, unit, word, prob: for each transcript its words in order, each with all its pronunciations.

    Nodes are numbered by what lies before them: a word's first node follows the inner nodes of all words
    before it, its pronunciations' inner nodes follow that one after the other. So arcs of one word share
    its ends alone, whatever the number of pronunciations and units. A word without a pronunciation has no arc, and no node.
    """
    ways = lexicon.withColumn("_inner", F.size("units") - 1)
    of_word = Window.partitionBy("word")
    earlier = of_word.orderBy("units", "prob").rowsBetween(Window.unboundedPreceding, -1)
    ways = ways.select(F.col("word").alias("_w"), "units", "prob", "_inner", F.coalesce(F.sum("_inner").over(earlier), F.lit(0)).alias("_before"))
    nodes = ways.groupBy("_w").agg((F.sum("_inner") + 1).alias("_nodes"))
    w = Window.partitionBy(key).orderBy(order)
    said = words.join(nodes, F.col(word) == F.col("_w")).drop("_w")
    said = said.withColumn("_at", F.sum("_nodes").over(w) - F.col("_nodes"))
    rows = said.join(ways, F.col(word) == F.col("_w")).select(key, word, "_at", "_nodes", "_before", "_inner", "prob", F.posexplode("units").alias("_i", "unit"))
    inner = lambda i: F.col("_at") + F.col("_before") + i
    src = F.when(F.col("_i") == 0, F.col("_at")).otherwise(inner(F.col("_i")))
    dst = F.when(F.col("_i") == F.col("_inner"), F.col("_at") + F.col("_nodes")).otherwise(inner(F.col("_i") + 1))
    return rows.select(key, src.cast("int").alias("src"), dst.cast("int").alias("dst"), "unit", F.when(F.col("_i") == 0, F.col(word)).alias("word"), F.when(F.col("_i") == 0, F.col("prob")).otherwise(1.0).alias("prob"))


def state_network(units: DataFrame, states: int = 3, loop: float = 0.5) -> DataFrame:
    """Unit arcs (net, arc, src, dst, unit, score) cut into `states` left-to-right states with loops: net, src, dst, unit, state, score.

    Nodes inside an arc have negative numbers, made of the arc's and the state's. A loop stands at the node behind its state.
    """
    steps = units.select("net", "arc", "src", "dst", "unit", "score", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("state"))
    inner = lambda s: (-(F.col("arc").cast("long") * states + s)).cast("long")
    a = F.when(F.col("state") == 0, F.col("src").cast("long")).otherwise(inner(F.col("state")))
    b = F.when(F.col("state") == states - 1, F.col("dst").cast("long")).otherwise(inner(F.col("state") + 1))
    entry = F.when(F.col("state") == 0, F.col("score")).otherwise(0.0)
    move = steps.select("net", a.alias("src"), b.alias("dst"), "unit", "state", (entry + F.log(F.lit(1 - loop))).alias("score"))
    stay = steps.select("net", b.alias("src"), b.alias("dst"), "unit", "state", F.log(F.lit(loop)).alias("score"))
    return move.union(stay)


def network_search(frames: DataFrame, arcs: list[tuple[int, int, str, str, float]], start: int, finals: dict[int, float], units: list[str], beam: float = 100.0, most: int = 5000, histories: bool = False) -> DataFrame:
    """utt, words, score of the best path of a network (src, dst, unit, word, score) through each utterance's frames.

    Each frame is spent on one arc; an arc may be taken again at once where it is a
    loop. One token per node is kept, or with `histories` one per node and words.
    Tokens below the beam and beyond `most` go after each frame.
    """
    out_of: dict[int, list] = {}
    place = {u: i for i, u in enumerate(units)}
    for a, b, u, word, s in arcs:
        out_of.setdefault(a, []).append((b, place[u], word, s))

    def search(scores: np.ndarray) -> tuple[str, float]:
        tokens: dict = {(start, ()) if histories else start: (0.0, ())}
        for frame in scores:
            new: dict = {}
            for key, (score, path) in tokens.items():
                for b, u, word, s in out_of.get(key[0] if histories else key, ()):
                    value, way = score + s + frame[u], (*path, word) if word else path
                    into = (b, way) if histories else b
                    if into not in new or (value, way) > new[into]:
                        new[into] = (value, way)
            if not new:
                return "", -1e15
            best = max(v for v, _ in new.values())
            tokens = dict(sorted(((k, v) for k, v in new.items() if v[0] >= best - beam), key=lambda x: (-x[1][0], str(x[0])))[:most])
        ends = [(v + finals[k[0] if histories else k], p) for k, (v, p) in tokens.items() if (k[0] if histories else k) in finals]
        value, path = max(ends, default=(-1e15, ()))
        return " ".join(path), float(value)

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        matrix = np.asarray(table.column("scores").combine_chunks().flatten(), float).reshape(-1, len(units))
        found = [search(matrix[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        return pa.table({"utt": table.column("utt").take(pa.array(begins[:-1])), "words": pa.array([w for w, _ in found]), "score": pa.array([s for _, s in found])})

    kind = frames.schema["utt"].dataType.simpleString()
    return map_groups(frames.select("utt", "frame", "scores"), "utt", ["frame"], run, f"utt {kind}, words string, score double")


def accepts_prefix(grammar: DataFrame, sentences: DataFrame, key: str, null: str = "!NULL") -> DataFrame:
    """key, matched: how many words of each sentence a grammar (src, dst, word) can follow from node 0; empty words are free.

    The grammar, which is small, is closed over its empty words once: a set of nodes and
    a word lead to one set of nodes. Distinct sentences are walked in Arrow batches.
    """
    arcs = [tuple(r) for r in grammar.select("src", "dst", "word").collect()]
    free: dict[int, set[int]] = {}
    steps: dict[tuple[int, str], set[int]] = {}
    for a, b, word in arcs:
        if word == null:
            free.setdefault(a, set()).add(b)
        else:
            steps.setdefault((a, word), set()).add(b)

    def closed(nodes: set[int]) -> frozenset[int]:
        out, todo = set(nodes), list(nodes)
        while todo:
            new = free.get(todo.pop(), set()) - out
            out |= new
            todo += new
        return frozenset(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[frozenset[int], str], frozenset[int]] = {}
        start = closed({0})
        for batch in batches:
            matched = []
            for words in batch.column("words").to_pylist():
                at, n = start, 0
                for word in words or ():
                    into = known.get((at, word))
                    if into is None:
                        into = known[at, word] = closed(set().union(*(steps.get((node, word), ()) for node in at)))
                    if not into:
                        break
                    at, n = into, n + 1
                matched.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(matched, pa.int32())], names=[key, "matched"])

    kind = sentences.schema[key].dataType.simpleString()
    return sentences.select(key, "words").mapInArrow(run, f"`{key}` {kind}, matched int").groupBy(key).agg(F.max("matched").alias("matched"))


def reachable(arcs: DataFrame, start: Column) -> DataFrame:
    """Nodes that arcs (src, dst) reach from those that `start` selects."""
    nodes = stored(arcs.where(start).select(F.col("src").alias("node")).distinct())
    edge = nodes
    while size := edge.count():
        # only what the last round found is followed; arcs and nodes never pass through the driver
        edge = F.broadcast(edge) if size <= FEW else edge.hint("merge")
        found = arcs.join(edge, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        edge = stored(found.join(nodes.hint("merge"), "node", "left_anti"))
        nodes = stored(nodes.union(edge))
    return nodes
