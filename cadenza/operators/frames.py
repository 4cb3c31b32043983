"""Frame streams: one row per (utt, frame) with a vector x, prepared for windows over neighbouring frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Frames of one utterance that one window group holds, besides its neighbours.
BLOCK = 4096


def numbered(events: DataFrame, **columns: Column) -> DataFrame:
    """utt, frame, n and the named columns of `events`: a user's events numbered in order.

    Events are ranked within a day and the numbers of the days before are added, so a user
    who has a great part of all events is as many groups as there are days.
    """
    day = F.date_trunc("day", "ts")
    sizes = events.groupBy(F.col("user_id").alias("_u"), day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_u")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_u", "_d", before.alias("_before"), F.sum("_n").over(w).cast("int").alias("n"))
    rows = events.withColumn("_day", day).join(starts, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d")))
    inside = F.row_number().over(Window.partitionBy("_u", "_d").orderBy("ts", "event_id"))
    return rows.select(F.col("user_id").alias("utt"), (F.col("_before") + inside - 1).cast("int").alias("frame"), "n", *[c.alias(name) for name, c in columns.items()])


def event_frames(events: DataFrame) -> DataFrame:
    """utt, frame, n, x of `events`: a user's events in order, as vectors (value, event_id mod 97, letters of event_type)."""
    x = F.array(F.col("value"), (F.col("event_id") % 97).cast("double"), F.length("event_type").cast("double"))
    return numbered(events, x=x)


def with_length(frames: DataFrame) -> DataFrame:
    """Add n, the number of frames of the utterance, to stored frames without it."""
    return frames.join(frames.groupBy("utt").agg((F.max("frame") + 1).cast("int").alias("n")), "utt")


def padded(frames: DataFrame, context: int, block: int = BLOCK) -> DataFrame:
    """Frames -context .. n-1+context, in blocks that overlap by `context`.

    The first and last frames are repeated outside, and only there: what is computed
    from frames sees real context at the borders. A frame near the edge of a block is
    also in the next one, so windows are over (utt, block) and a long utterance is
    many groups. `trimmed` takes away what was added.
    """
    before = F.when(F.col("frame") == 0, -context).otherwise(F.col("frame"))
    after = F.when(F.col("frame") == F.col("n") - 1, F.col("frame") + context).otherwise(F.col("frame"))
    rows = frames.withColumn("frame", F.explode(F.sequence(before, after)))
    first = F.floor((F.col("frame") - context) / block)
    last = F.floor((F.col("frame") + context) / block)
    return rows.withColumn("block", F.explode(F.sequence(first, last)))


def trimmed(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """The frames 0 .. n-1, each once."""
    own = F.floor(F.col("frame") / block) == F.col("block")
    return frames.where(F.col("frame").between(0, F.col("n") - 1) & own).drop("block")


def in_order() -> WindowSpec:
    return Window.partitionBy("utt", "block").orderBy("frame")


def time_range(frames: DataFrame, start: float, end: float, rate: float = 125.0) -> DataFrame:
    """Frames from start to end seconds; an end of 0 is no end."""
    kept = F.col("frame") >= int(start * rate)
    return frames.where(kept & (F.col("frame") < int(end * rate)) if end else kept)


def elements(x: Column, dim: int) -> list[Column]:
    return [F.element_at(x, i + 1) for i in range(dim)]


def unpacked(frames: DataFrame, column: str, dim: int, digits: int = 6) -> DataFrame:
    """utt, frame and the rounded elements x0, x1, ... of a vector; zeros have no sign."""
    return frames.select("utt", "frame", *[(F.round(c, digits) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(elements(F.col(column), dim))])
