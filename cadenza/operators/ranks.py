"""Exact ranks and order statistics that no single task must sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Ranges into which the values of one key are divided.
RANGES = 64


def exact_ranks(values: DataFrame, key: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add rank (from 0) of each row among those with its key, by value and then `ties`.

    Approximate quantiles divide each key into ranges of about equal size; rows are
    ranked within a range and the sizes of the ranges before are added.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = values.groupBy(F.col(key).alias("_k")).agg(F.array_distinct(F.percentile_approx(value, shares, 1000)).alias("_cuts"))
    rows = values.join(cuts, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = rows.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.withColumn("_before", before), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(value, *ties))
    return rows.withColumn("rank", F.col("_before") + inside - 1).drop("_k", "_r", "_n", "_before", "_range")


def quantile_values(values: DataFrame, key: str, value: str, parts: int = 4) -> DataFrame:
    """key, q, v: the element at place ceil(n (q+1) / parts) - 1 of each key's sorted values."""
    n = values.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = n.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_at", (F.ceil(F.col("_n") * (F.col("q") + 1) / parts) - 1).cast("long"))
    ranked = exact_ranks(values, key, value)
    return ranked.join(wanted, F.col(key).eqNullSafe(F.col("_k")) & (F.col("rank") == F.col("_at"))).select(key, "q", F.col(value).alias("v"))


def global_ranks(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Add rank (from 0) of each row in the whole table's order, and the number of rows.

    Rows are put into ranges of the order and stored; a range's rows are ranked there, and
    the sizes of the ranges before it, which are one number a range, are added.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_range").count().collect())
    starts, n = {}, 0
    for part, size in sizes:
        starts[part], n = n, n + size
    if not starts:
        return ranged.drop("_range").withColumn("rank", F.lit(0)), 0
    begin = ranged.sparkSession.createDataFrame(list(starts.items()), "_range int, _begin long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(F.broadcast(begin), "_range").withColumn("rank", F.col("_begin") + inside - 1)
    return ranked.drop("_range", "_begin"), n
