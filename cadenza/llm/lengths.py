"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Texts are encoded in their partitions and only lengths are shuffled, summed up
before that. A histogram has a row per distinct length; running sums over it are
split over ranges of lengths. Nulls and empty texts have length 0. Repeated rows
count each. An empty table gives an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_text, running_before
from .tokenized import broadcast_spec, library_encoder

#: Lengths that are summed in one group.
RANGE = 4096


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens of each text, without special tokens."""
    spark = docs.sparkSession
    spec = broadcast_spec(spark, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, at = library_encoder(spec.value)(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(np.diff(at), pa.int64())], names=["n_tokens"])

    return map_text(docs.select("text"), run, "n_tokens long")


def length_histogram(counts: DataFrame, rows: str | None = None) -> DataFrame:
    """For each length that occurs, taken as a context limit: what lies at and beyond it.

    `counts` has n_tokens of each text, or of groups of texts whose number is in the column `rows`.

    n_docs documents have that length; docs_within and tokens_within count those
    of that length or less, docs_beyond and tokens_beyond the longer ones;
    truncated_tokens is the total when every text is cut at the limit;
    quantile is the share of documents of that length or less.
    """
    hist = counts.groupBy("n_tokens").agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n_docs"))
    hist = hist.withColumns({"n_tokens_sum": F.col("n_tokens") * F.col("n_docs"), "range": F.expr(f"n_tokens div {RANGE}")})
    up = running_before(hist, [], "range", [F.col("n_tokens")], {"docs_before": ("sum", "n_docs"), "tokens_before": ("sum", "n_tokens_sum")})
    both = running_before(up.withColumn("back", -F.col("range")), [], "back", [F.col("n_tokens").desc()], {"docs_beyond": ("sum", "n_docs"), "tokens_beyond": ("sum", "n_tokens_sum")})
    within = F.col("docs_before") + F.col("n_docs")
    tokens = F.col("tokens_before") + F.col("n_tokens_sum")
    return both.select(
        "n_tokens",
        "n_docs",
        within.alias("docs_within"),
        tokens.alias("tokens_within"),
        "docs_beyond",
        "tokens_beyond",
        (tokens + F.col("docs_beyond") * F.col("n_tokens")).alias("truncated_tokens"),
        (within.cast("double") / (within + F.col("docs_beyond"))).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column:
    """An aggregate over a histogram: the total when texts are cut at `limit`, whether or not that length occurs."""
    return F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0).cast("long"))


def quantile_length(histogram: DataFrame, share: float) -> Column:
    """An aggregate over a histogram: the least length that at least `share` of the documents do not exceed."""
    return F.min(F.when(F.col("quantile") >= share, F.col("n_tokens")))
