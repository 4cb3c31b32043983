"""Segments of frames: runs, labels by frame, overlap scores, limits and label parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import BLOCK


def label_runs(frames: DataFrame, label: str = "label", block: int = BLOCK) -> DataFrame:
    """utt, start, end (exclusive), label of runs of equal labels in frame order.

    Frames are compared in blocks, which have the frame before them too. A run is first a part of each
    block that it touches; parts that meet are put together.
    """
    rows = frames.select("utt", "frame", F.col(label).alias("label"))
    spread = rows.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(F.col("frame") / block), F.floor((F.col("frame") + 1) / block)))))
    w = Window.partitionBy("utt", "_block").orderBy("frame")
    same = F.col("label").eqNullSafe(F.lag("label").over(w)) & (F.lag("frame").over(w) == F.col("frame") - 1)
    first = F.col("frame") == F.col("_block") * block
    marked = spread.select("*", F.coalesce(same, F.lit(False)).alias("_same")).where(F.floor(F.col("frame") / block) == F.col("_block"))
    # a block's first frame begins a part even where it goes on with a run
    parts = marked.withColumn("_part", F.sum(F.when(F.col("_same") & ~first, 0).otherwise(1)).over(w))
    parts = parts.groupBy("utt", "_block", "_part").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.first("label").alias("label"), F.min_by("_same", "frame").alias("_same"))
    inner = parts.where((F.col("start") != F.col("_block") * block) & (F.col("end") != (F.col("_block") + 1) * block)).select("utt", "start", "end", "label")
    # only parts at the edges of blocks can meet: two a block
    edge = parts.where((F.col("start") == F.col("_block") * block) | (F.col("end") == (F.col("_block") + 1) * block))
    run = F.sum(F.when(F.col("_same") & (F.col("start") == F.col("_block") * block), 0).otherwise(1)).over(Window.partitionBy("utt").orderBy("start"))
    joined = edge.withColumn("_run", run).groupBy("utt", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"))
    return inner.union(joined.select("utt", "start", "end", "label"))


def frame_labels(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame with the segment that holds it: segments are spread to frames, so the join is on equality."""
    spread = segments.where("start < `end`").select("utt", F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"), "start", "end", "label")
    return frames.join(spread, ["utt", "frame"])


def overlap_scores(hypotheses: DataFrame, references: DataFrame, width: int = 64) -> DataFrame:
    """utt, start, end, label and score of each hypothesis: over all references that it overlaps by a share e of
    the reference, the best of -1 + 2e where labels agree and -1 + e where not; -1 without overlap.

    Both sides are spread over stretches of `width` frames that they touch, so
    only segments of one stretch meet; a pair counts in the stretch where it begins.
    """

    def spread(df: DataFrame, *names: str) -> DataFrame:
        tiles = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where("start < `end`").select(F.col("utt"), F.explode(tiles).alias("tile"), *[F.col(a).alias(b) for a, b in zip(("start", "end", "label"), names, strict=True)])

    h, r = spread(hypotheses, "start", "end", "label"), spread(references, "r_start", "r_end", "r_label")
    low, high = F.greatest("start", "r_start"), F.least("end", "r_end")
    share = (high - low) / (F.col("r_end") - F.col("r_start"))
    score = F.when(F.col("label") == F.col("r_label"), -1 + 2 * share).otherwise(-1 + share)
    pairs = h.join(r, ["utt", "tile"]).where((low < high) & (F.floor(low / width) == F.col("tile")))
    best = pairs.groupBy("utt", "start", "end", "label").agg(F.max(score).alias("score"))
    return hypotheses.join(best, ["utt", "start", "end", "label"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def clipped(segments: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """Segments within frames first .. last, cut at the limits; a last of 0 is no limit."""
    kept = segments.where(F.col("end") > first)
    if last:
        kept = kept.where(F.col("start") < last)
    end = F.least("end", F.lit(last)) if last else F.col("end")
    return kept.withColumns({"start": F.greatest("start", F.lit(first)), "end": end})


def is_silence(label: Column) -> Column:
    """Labels that begin with an underscore and have no context."""
    return label.rlike(r"^_[^-+]*$")


def centre_phone(label: Column) -> Column:
    """b of a-b+c: what follows the last hyphen, up to the first plus sign, or without one to the next semicolon; the label itself if that is nothing."""
    left = F.when(F.contains(label, F.lit("-")), F.length(label) - F.instr(F.reverse(label), "-") + 1).otherwise(0)
    plus = F.instr(label, "+")
    right = F.when(plus > 0, plus).otherwise(F.position(F.lit(";"), label, F.greatest(left, F.lit(1))))
    inside = F.when((left > 0) & (right > left + 1), F.substring(label, left + 1, right - left - 1))
    found = inside.when(right > 0, F.substring(label, F.lit(1), right - 1)).when(left > 0, F.substring(label, left + 1, F.length(label))).otherwise(label)
    return F.when(found != "", found).otherwise(label)


def sublabel(label: Column, n: int) -> Column:
    """The nth field, from 0, of a label whose fields are divided by semicolons; empty if there is none."""
    return F.coalesce(F.get(F.split(label, ";"), F.lit(n)), F.lit(""))


def triphones(units: DataFrame, group: str, order: str, unit: str) -> DataFrame:
    """left-centre+right of successive units; without a neighbour that part is left out."""
    w = Window.partitionBy(group).orderBy(order)
    left, right = F.lag(unit).over(w), F.lead(unit).over(w)
    name = F.concat(F.when(left.isNotNull(), F.concat(left, F.lit("-"))).otherwise(""), F.col(unit), F.when(right.isNotNull(), F.concat(F.lit("+"), right)).otherwise(""))
    return units.withColumn("triphone", name)
