"""Chat formatting after collapsing cumulative snapshots.

A log holds a conversation again each time it grows. Each turn gets a rolling hash of
all turns up to it: the exclusive-or of hashes of (place, role, text), which a
running window gives, in two lanes of 64 bits. A conversation is dropped if its last
hash is a prefix hash of a longer one, or if it equals one with a smaller conv_id.
The anti-joins are on distinct hashes, which are combined before they are shuffled,
so a first turn that very many conversations share is one row.

Turns are put into ranges of about equal size by their whole order, so the turns of
one conversation are split over many window groups whatever their numbers are; only
rendering brings a conversation together, into its own text.

Turns are ordered by turn (nulls first), then role and text; repeated turns stay.
Null roles and texts are told apart from empty ones and render as empty. Rows with
a null conv_id are one conversation. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, running_before

#: Letters of a text by which equal turns and roles are put into ranges.
HEAD = 32
#: The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text, place (from 1), n (turns of the conversation) and the lanes a, b of the hash of all turns up to each."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # the beginning of a text orders as the text does and is short enough to be sampled
    head = F.substring("text", 1, HEAD)
    ranged = turns.select("conv_id", "turn", "role", "text").repartitionByRange(F.col("conv_id").asc_nulls_first(), *order[:2], head.asc_nulls_first())
    # stored, so that a range keeps its number
    order.append(F.col("line"))
    ranged = scratch.put(ranged.withColumns({"range": F.spark_partition_id(), "line": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")}), "ranges")
    rows = running_before(ranged, ["conv_id"], "range", order, {"before": ("sum", "one")}, {"before": "n"})
    parts = [F.col("before"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rows = rows.withColumns({"place": F.col("before") + 1, "x": F.xxhash64(*parts), "y": F.xxhash64(F.lit("second lane"), *parts)})
    rows = running_before(rows, ["conv_id"], "range", order, {"a": ("bit_xor", "x"), "b": ("bit_xor", "y")})
    return rows.select("conv_id", "turn", "role", "text", "place", "n", F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one repeats or continues."""
    whole = hashes.where("place = n").groupBy("a", "b", "place").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("place < n").select("a", "b", "place").distinct()
    return whole.join(inner, ["a", "b", "place"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns and the text of each conversation in `kept`, turn by turn."""
    named = kept.select(F.col("conv_id").alias("c"), "n_turns")
    rows = turns.join(named, F.col("conv_id").eqNullSafe(F.col("c")))
    part = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
    return rows.select("conv_id", "n_turns", F.array_join(F.col("parts.part"), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the maximal conversations."""
    scratch = Scratch(turns.sparkSession, "chat")
    hashes = scratch.put(prefix_hashes(turns, scratch), "hashes", keep=True)
    scratch.drop()
    return render(hashes, maximal_conversations(hashes))
