"""A lexicon as a network of triphones that hold across words, as a table of arcs.

Any word may follow any other. Nodes are named by what they know:

* `x|y`: the last unit of the word before was x, and the next word begins with y;
* `u v>w`: units u v of a word have been heard, and w is next: a tree of prefixes;
* `a<b`: b is the last unit of a word, behind a;
* `<s>` begins and `</s>` ends.

From `x|y` triphones x-y+z (the fan-in) lead to `y>z`; through the tree and, with the word, into `a<b`; from there
triphones a-b+y (the fan-out) lead to `b|y`. So all words that begin or end alike share these, and the
network grows with the prefixes of the lexicon plus units times pairs of units. Words of one unit
lead from `x|u` to `u|y`. Begin and end have no neighbour: y+z, a-b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units that words may begin or end with; their names are held by the driver.
MOST_UNITS = 2000
BEGIN, END = "<s>", "</s>"


def _names(column: DataFrame) -> list[str]:
    """The distinct values of a table of one column, sorted; few by their nature."""
    found = [r[0] for r in column.distinct().limit(MOST_UNITS + 1).collect()]
    if len(found) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    return sorted(found)


def triphone_network(lexicon: DataFrame) -> DataFrame:
    """src, dst, triphone, word, prob: arcs of the network of a lexicon (word, prob, units).

    An arc without a triphone takes no time. A word and its probability are on the arc into its last unit, or
    on all arcs of a word of one unit. Pronunciations without units are left out.
    """
    words = lexicon.where(F.size("units") > 0).select("word", F.col("prob").cast("double").alias("prob"), "units", F.size("units").alias("n")).distinct()
    first, last = F.element_at("units", 1), F.element_at("units", -1)
    firsts = _names(words.select(first))
    lasts = _names(words.select(last))
    some = lambda names: F.explode(F.array(*map(F.lit, names)))
    none, free = F.lit(None).cast("string"), F.lit(1.0)
    junction = lambda x, y: F.when(x == "", F.lit(BEGIN)).otherwise(F.concat_ws("|", x, y))
    out = []
    # fan-in: one for each left neighbour and each pair of first units
    starts = words.where("n > 1").select(first.alias("y"), F.element_at("units", 2).alias("z")).distinct().withColumn("x", some(["", *lasts]))
    left = F.when(F.col("x") == "", "").otherwise(F.concat("x", F.lit("-")))
    out.append(starts.select(junction(F.col("x"), F.col("y")).alias("src"), F.concat_ws(">", "y", "z").alias("dst"), F.concat(left, "y", F.lit("+"), "z").alias("triphone"), none.alias("word"), free.alias("prob")))
    # the tree: prefixes of 2 and more units
    inner = words.where("n > 2").select("units", F.explode(F.sequence(F.lit(1), F.col("n") - 2)).alias("k"))
    prefix = lambda k: F.concat_ws(">", F.array_join(F.slice("units", 1, k), " "), F.get("units", k))
    unit = lambda k: F.get("units", k)
    k = F.col("k")
    out.append(inner.select(prefix(k).alias("src"), prefix(k + 1).alias("dst"), F.concat(unit(k - 1), F.lit("-"), unit(k), F.lit("+"), unit(k + 1)).alias("triphone"), none.alias("word"), free.alias("prob")).distinct())
    # words
    end = F.concat_ws("<", F.element_at("units", -2), last)
    longer = words.where("n > 1")
    out.append(longer.select(prefix(F.col("n") - 1).alias("src"), end.alias("dst"), none.alias("triphone"), "word", "prob"))
    # fan-out: one for each pair of last units and each right neighbour
    ends = longer.select(F.element_at("units", -2).alias("a"), last.alias("b")).distinct()
    out.append(ends.withColumn("y", some(firsts)).select(F.concat_ws("<", "a", "b").alias("src"), F.concat_ws("|", "b", "y").alias("dst"), F.concat("a", F.lit("-"), "b", F.lit("+"), "y").alias("triphone"), none.alias("word"), free.alias("prob")))
    out.append(ends.select(F.concat_ws("<", "a", "b").alias("src"), F.lit(END).alias("dst"), F.concat("a", F.lit("-"), "b").alias("triphone"), none.alias("word"), free.alias("prob")))
    # words of one unit, between all neighbours
    single = words.where("n = 1").select("word", "prob", first.alias("u")).withColumn("x", some(["", *lasts])).withColumn("y", some([*firsts, ""]))
    right = F.when(F.col("y") == "", "").otherwise(F.concat(F.lit("+"), "y"))
    into = F.when(F.col("y") == "", F.lit(END)).otherwise(F.concat_ws("|", "u", "y"))
    out.append(single.select(junction(F.col("x"), F.col("u")).alias("src"), into.alias("dst"), F.concat(left, "u", right).alias("triphone"), "word", "prob"))
    network = out[0]
    for part in out[1:]:
        network = network.union(part)
    return network


def tied_states(arcs: DataFrame, models: DataFrame) -> DataFrame:
    """src, dst, state, word, prob: the network with states for triphones, which arcs of one node share.

    `models` has name and states (an array of strings) of triphones and of single units: a triphone without a model has
    its centre unit's, and without that its arcs go. Arcs of one node whose models begin with the same states are one
    path as long as they agree; where tied models agree in all states only arcs without a state, into
    their ends, are apart. A state's loop is at the node behind it.
    """
    from .segments import centre_phone

    known = models.select("name", "states")
    spoken = arcs.where("triphone is not null")
    named = spoken.join(known, spoken["triphone"] == known["name"], "left").drop("name")
    centre = known.select(F.col("name").alias("_centre"), F.col("states").alias("_states"))
    named = named.join(centre, centre_phone(F.col("triphone")) == F.col("_centre"), "left")
    named = named.withColumn("states", F.coalesce("states", "_states")).where(F.size("states") > 0)
    node = lambda k: F.when(k == 0, F.col("src")).otherwise(F.concat(F.col("src"), F.lit("#"), F.array_join(F.slice("states", 1, k), " ")))
    steps = named.select("src", "states", F.posexplode("states").alias("k", "state"))
    inside = steps.select(node(F.col("k")).alias("_src"), node(F.col("k") + 1).alias("dst"), "state", F.lit(None).cast("string").alias("word"), F.lit(1.0).alias("prob")).distinct().withColumnRenamed("_src", "src")
    leave = named.select(node(F.size("states")).alias("_src"), "dst", F.lit(None).cast("string").alias("state"), "word", "prob").distinct().withColumnRenamed("_src", "src")
    silent = arcs.where("triphone is null").select("src", "dst", F.lit(None).cast("string").alias("state"), "word", "prob")
    return inside.union(leave).union(silent)
