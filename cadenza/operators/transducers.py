"""Transducers as tables of arcs (src, dst, input, output, weight) and of final states (state, weight).

Weights add up along a path. A null label is empty: it takes or gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Rounds

#: Moves after which only some may follow, so that each pair of paths is composed in one way.
BOTH, LEFT, RIGHT = 0, 1, 2


def lexicon_transducer(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units to words: each pronunciation (word, prob, units) is a loop at state `` that gives its word at its first unit.

    States inside are named by the word and the units that are left, so equal ends of one word are shared. Weights are -ln prob.
    """
    rows = lexicon.where(F.size("units") > 0).select("word", "prob", "units", F.posexplode("units").alias("k", "unit"))
    rest = lambda k: F.array_join(F.slice("units", k + 1, F.size("units")), " ")
    inside = lambda k: F.when((k == 0) | (k == F.size("units")), "").otherwise(F.concat("word", F.lit(":"), rest(k)))
    first = F.col("k") == 0
    arcs = rows.select(inside(F.col("k")).alias("src"), inside(F.col("k") + 1).alias("dst"), F.col("unit").alias("input"), F.when(first, F.col("word")).alias("output"), F.when(first, -F.log("prob")).otherwise(0.0).alias("weight"))
    return arcs.distinct(), lexicon.sparkSession.createDataFrame([("", 0.0)], "state string, weight double")


def sentence_grammar(sentences: DataFrame, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """An acceptor of all ways between neighbours in `sentences` (arrays of words): states are the last word, weights -ln of their share."""
    rows = sentences.where(F.size(words) > 0).select(F.posexplode(words).alias("k", "word"), F.col(words).alias("all"))
    before = F.when(F.col("k") == 0, "").otherwise(F.get("all", F.col("k") - 1))
    steps = rows.select(before.alias("src"), F.col("word").alias("dst")).union(rows.where(F.col("k") == F.size("all") - 1).select("word", F.lit(None).cast("string")))
    counts = steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("src").agg(F.sum("c").alias("t"))
    scored = counts.join(whole, "src").withColumn("weight", -F.log(F.col("c") / F.col("t")))
    arcs = scored.where("dst is not null").select("src", "dst", F.col("dst").alias("input"), F.col("dst").alias("output"), "weight")
    return arcs, scored.where("dst is null").select(F.col("src").alias("state"), "weight")


def compose(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], start: tuple = ("", "")) -> tuple[DataFrame, DataFrame]:
    """left then right: arcs (src, dst, input, output, weight) and finals (state, weight) of what can be reached from the pair of starts.

    A state is a struct of both states and of the last kind of move. Arcs whose output is the other's input move both; an empty output
    moves the left alone, an empty input the right alone, and both empty move together: left-alone moves may not follow
    right-alone ones, nor the other way round, nor both-empty ones either of them, so no pair of paths is found twice.
    Rounds follow pairs that the last one found, by joins on states and labels; the arcs are those of the rounds.
    """
    spark = left[0].sparkSession
    a = left[0].select(F.col("src").alias("a_src"), F.col("dst").alias("a_dst"), F.col("input").alias("a_in"), F.col("output").alias("a_out"), F.col("weight").cast("double").alias("a_w"))
    b = right[0].select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), F.col("input").alias("b_in"), F.col("output").alias("b_out"), F.col("weight").cast("double").alias("b_w"))
    kinds = {c: t for t in (a, b) for c, t in t.dtypes}
    rounds = Rounds(spark, "compose")
    first = spark.createDataFrame([(*start, BOTH)], f"a {kinds['a_src']}, b {kinds['b_src']}, f int")
    edge, found = rounds.put(first), []
    seen = edge  # the union of what each round found, never written again
    null = F.lit(None).cast("string")
    state = lambda x, y, f: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(f).alias("f") if isinstance(f, int) else F.col(f).alias("f"))
    while not edge.isEmpty():
        here = state("a", "b", "f").alias("src")
        from_left = edge.join(a, F.col("a") == F.col("a_src"))
        matched = from_left.join(b, (F.col("b") == F.col("b_src")) & (F.col("a_out") == F.col("b_in")))
        both = matched.select(here, state("a_dst", "b_dst", BOTH).alias("dst"), F.col("a_in").alias("input"), F.col("b_out").alias("output"), (F.col("a_w") + F.col("b_w")).alias("weight"))
        empty = from_left.where(f"a_out is null and f = {BOTH}").join(b.where("b_in is null"), F.col("b") == F.col("b_src"))
        together = empty.select(here, state("a_dst", "b_dst", BOTH).alias("dst"), F.col("a_in").alias("input"), F.col("b_out").alias("output"), (F.col("a_w") + F.col("b_w")).alias("weight"))
        alone = from_left.where(f"a_out is null and f <> {RIGHT}").select(here, state("a_dst", "b", LEFT).alias("dst"), F.col("a_in").alias("input"), null.alias("output"), F.col("a_w").alias("weight"))
        other = edge.where(f"f <> {LEFT}").join(b.where("b_in is null"), F.col("b") == F.col("b_src")).select(here, state("a", "b_dst", RIGHT).alias("dst"), null.alias("input"), F.col("b_out").alias("output"), F.col("b_w").alias("weight"))
        step = rounds.put(both.union(together).union(alone).union(other))
        found.append(step)
        edge = rounds.put(step.select("dst.*").distinct().join(seen, ["a", "b", "f"], "left_anti"))
        seen = seen.union(edge)
    arcs = found[0]
    for step in found[1:]:
        arcs = arcs.union(step)
    states = arcs.select("src").union(arcs.select("dst")).union(first.select(state("a", "b", "f").alias("src"))).distinct()
    ends = left[1].select(F.col("state").alias("a"), F.col("weight").cast("double").alias("a_w")).join(states.select("src", "src.*"), "a")
    ends = ends.join(right[1].select(F.col("state").alias("b"), F.col("weight").cast("double").alias("b_w")), "b")
    return arcs, ends.select(F.col("src").alias("state"), (F.col("a_w") + F.col("b_w")).alias("weight"))


def trimmed(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """The arcs from which a final state can be reached, by rounds backwards from these."""
    rounds = Rounds(arcs.sparkSession, "trim")
    edge = rounds.put(finals.select(F.col("state").alias("node")).distinct())
    live = edge
    while not edge.isEmpty():
        back = arcs.join(edge, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct()
        edge = rounds.put(back.join(live, "node", "left_anti"))
        live = live.union(edge)
    return arcs.join(live, F.col("dst") == F.col("node"), "left_semi")
