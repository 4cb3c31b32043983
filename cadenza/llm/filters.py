"""What quality filters remove together: an audit by inclusion and exclusion.

Each document gets a flag for each filter that it fails. For all 2 ** n sets of
filters the products of their flags are summed: the joint failures J(S). All else
follows from these few numbers, whatever the order in which filters are applied:

* survivors of a set P of filters: the sum of (-1) ** |S| J(S) over S within P;
* what a filter removes after P: survivors of P less survivors of P with it;
* redundant failures: J of the filter alone less what it removes;
* unique failures: the sum of (-1) ** (|S| - 1) J(S) over S that hold the filter;
* the Shapley share: a union of failures has the Harsanyi dividend (-1) ** (|S| - 1) J(S)
  at S, and each filter in S gets an equal part of it. Times n! all are whole numbers.

Whether a text is repeated is told by a digest of the whole text. Rows that agree in
doc_id, part and text are counted as one row with a weight, then all rows of one text,
part and labels: so a text that a third of all rows hold is a few rows before the
rows of a text meet. Nothing but digests and flags is shuffled.

Null texts are empty texts; a null source is the empty string. A null doc_id is neither
smaller nor larger than any: its row never counts as a repeat, nor makes another one.
Rows that agree in doc_id and text are no repeats of each other. A document with
several rows in `labels` is good (toxic) if any says so; one without a label is neither.
An empty table gives no part and so no row. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD

#: The filters by their letters; E, which compares rows, is set apart.
ROW_FILTERS, REPEATED = "ABCD", "E"
FILTERS = ROW_FILTERS + REPEATED
#: Bounds of the filters: least words, least share of distinct words, most share of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
#: Counts that are kept apart: all documents, good ones, toxic ones.
WEIGHTS = ("all", "good", "toxic")


def row_failures(text: Column) -> dict[str, Column]:
    """1 for each filter of ROW_FILTERS that a text fails, else 0."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    fails = {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }
    return {letter: fail.cast("long") for letter, fail in fails.items()}


def weighted_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, the flags A to D, n (rows) and n_repeated (those of them that fail E), many rows to one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *[f.alias(c) for c, f in row_failures(text).items()])
    flags = list(ROW_FILTERS)  # functions of the text
    rows = flagged.groupBy("doc_id", "part", "same", *flags).agg(F.count(F.lit(1)).alias("n"))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))])
    rows = rows.join(says, rows["doc_id"] == says["labelled"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in WEIGHTS[1:]})
    # a doc_id occurs once in each group: its rows in the group are its weight
    groups = rows.groupBy("same", "part", *WEIGHTS[1:], *flags).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("same"))  # rows of a text: one a part and labels
    firsts = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0))
    return groups.select("part", *WEIGHTS[1:], *flags, "n", (F.col("n") - F.col("unnamed") - firsts).alias("n_repeated"))


def joint_failures(weighted: DataFrame) -> DataFrame:
    """part, set (filters as a number) and for each of WEIGHTS the documents that fail all of the set: products of flags, summed."""
    n = len(FILTERS)
    kinds = weighted.groupBy("part", *WEIGHTS[1:], *ROW_FILTERS).agg(F.sum("n").alias("n"), F.sum("n_repeated").alias("n_repeated"))  # 64 rows a part
    sets = kinds.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    in_set = lambda c: F.expr(f"shiftright(set, {FILTERS.index(c)}) & 1") == 1
    flags = [F.when(in_set(c), F.col(c)).otherwise(1) for c in ROW_FILTERS]
    failing = reduce(lambda x, y: x * y, flags, F.when(in_set(REPEATED), F.col("n_repeated")).otherwise(F.col("n")))
    weights = {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return sets.groupBy("part", "set").agg(*[F.sum(failing * w).alias(name) for name, w in weights.items()])


def audit(joint: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from joint failures alone."""
    n = len(FILTERS)
    fields = ", ".join(f"{w}: bigint" for w in WEIGHTS)
    by_set = F.array_sort(F.collect_list(F.struct("set", *WEIGHTS)))  # all sets, in their order
    parts = joint.groupBy("part").agg(by_set.cast(f"array<struct<set: int, {fields}>>").alias("j"))
    sets, filters = f"sequence(0, {(1 << n) - 1})", f"sequence(0, {n - 1})"
    survivors = {w: F.expr(f"transform({sets}, p -> aggregate(filter(j, x -> x.set & p = x.set), 0L, (sum, x) -> sum + if(bit_count(x.set) % 2 = 0, x.{w}, -x.{w})))") for w in WEIGHTS}
    over = "transform({filters}, i -> aggregate(filter(j, x -> shiftright(x.set, i) & 1 = 1), 0L, (sum, x) -> sum + if(bit_count(x.set) % 2 = 1, {share} x.all, -{share} x.all)))"
    unique = over.format(filters=filters, share="")
    shapley = over.format(filters=filters, share=f"{factorial(n)} div bit_count(x.set) *")
    parts = parts.select("part", F.expr(f"transform({filters}, i -> j[shiftleft(1, i)].all)").alias("alone"), F.expr(unique).alias("unique"), F.expr(shapley).alias("shapley"), *[survivors[w].alias(f"left_{w}") for w in WEIGHTS])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = reduce(lambda x, y: x + y, [F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)])
    rows = rows.withColumns({"own": own, "before": before}).withColumn("after", F.col("before") + F.expr("shiftleft(1, own)"))
    lost = lambda w: F.get(f"left_{w}", "before") - F.get(f"left_{w}", "after")
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("left_all", "after").alias("kept"),
        lost("all").alias("removed"),
        (F.get("alone", "own") - lost("all")).alias("redundant"),
        F.get("unique", "own").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", "own").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each filter in each of the orders."""
    return audit(joint_failures(weighted_failures(docs, labels)))
