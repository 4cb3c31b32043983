"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, ranges of the key (more of
them for larger sources) are summed apart, so the running sum of sizes in key
order is spread over many tasks also where one source holds most rows. A source
whose target is below its size is cut where the running sum reaches the target;
one whose target is above takes its documents whole as often as they fit and
then the rest in key order.

Nulls: a null text has size 0; null sources form one source, ordered last; a null
doc_id is hashed as null. Repeated rows are rows of their own; rows that agree in
doc_id, source and size are interchangeable, and are one row with a count until all running
sums are made: so a doc_id that most rows bear is as many rows as it has sizes. An empty table
gives an empty mix; a source without words takes none. Other columns are ignored by `mix` and kept by
`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import PART_BYTES, WORD, Scratch, digest, fresh, in_parts, running_before

#: Documents in one range of keys.
RANGE_ROWS = 20_000
SALT = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(doc_id: Column) -> Column:
    """Fifteen hexadecimal digits of a hash, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SALT), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target.

    Sources by code point, nulls last, have the weights in turn and share the
    whole size. No target exceeds `most` times its source's size: water rises in
    all sources by weight and stops in those that are full. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    named = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    named = named.withColumns({"weight": weight, "full": (F.col("source_size") * most).cast("double")})
    fill = Window.orderBy((F.col("full") / F.col("weight")), "rank")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    named = named.withColumn("level", level)
    # the first source that is not full at its level stands at the final one
    final = F.first(F.when(F.col("full") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(final * F.col("weight"), F.col("full"))
    return named.select("source", "source_size", "n_docs", target.alias("target"))


def mix(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, whole: bool = False, unit: str | None = None) -> DataFrame:
    """How many words the mix takes of each document.

    `sized` has doc_id, source and size and is read twice, so it should be stored.
    Returns doc_id, size, source_size, target, taken, source, and the column `unit`
    if there is one: a digest that no two rows share, from which the keys are made then. `taken` counts
    repeats. The document at which the budget ends is cut there, or with `whole`
    taken or left as a whole, whichever is nearer.
    """
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "_source")
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    rest = [unit] if unit else []
    alike = sized.groupBy("doc_id", "source", "size", *rest).agg(F.count(F.lit(1)).alias("copies"))
    rows = alike.withColumn("whole_size", F.col("size") * F.col("copies")).join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    named = F.hex(unit) if unit else F.col("doc_id")
    rows = rows.withColumn("key", random_key(named)).withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * ranges))
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), *rest]
    rows = running_before(rows, ["source"], "range", order, {"first": ("sum", "whole_size")})
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("before", F.col("first") + (F.col("copy") - 1) * F.col("size"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"epochs": epochs, "rest": budget - epochs * F.col("source_size")})
    left = F.col("rest") - F.col("before")
    part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")) if whole else F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    taken = F.when(F.col("size") > 0, F.col("epochs") * F.col("size") + part).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", *rest)


def size_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source and size of all documents, stored: texts are read once."""
    return scratch.put(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes", keep=True)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it whole.

    Rows meet the plan by a digest of doc_id, source and text, in one shuffle. Rows that
    agree in these three are one unit of the mix: all of them are taken, as often as
    each other, or none. Documents without words are left out. `docs` is counted and read twice, so it should be stored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key, times = fresh("_unit", docs), fresh("_times", docs)
    unit = digest("doc_id", "source", "text")
    rows = docs.select(unit.alias("unit"), "doc_id", "source", word_count(F.col("text")).alias("words"), F.octet_length("text").cast("long").alias("n_bytes"))
    units = rows.groupBy("unit").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sum("words").alias("size"), F.sum("n_bytes").alias("n_bytes"))
    units = scratch.put(in_parts(units, docs.count()), "units", keep=True)
    plan = mix(units, weights, most, whole=True, unit="unit")
    plan = plan.where("taken > 0").select(F.col("unit").alias(key), F.expr("taken div size").alias(times))
    joined = docs.withColumn(key, unit).join(plan, key)
    joined = in_parts(joined, units.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], PART_BYTES)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[f"`{c}`" for c in docs.columns])
