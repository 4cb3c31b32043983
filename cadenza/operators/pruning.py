"""Beams of searches that follow the number of tokens.

Each frame keeps the tokens within the beam of the best one. Where more than `most` came, the
scores above the beam's limit are counted in BINS bins; from the worst bin on tokens go until
fewer than `most` are left, and the beam of the next frame is what the rest spans. Where no more than
`most` came, the beam grows by GROWTH, up to its full width. The limit never lies above the best score:
equal scores stay together, and the beam stays as it is if all scores are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups

BINS, GROWTH = 100, 1.1


def histogram_limits(group: np.ndarray, score: np.ndarray, beam: np.ndarray, width: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least score that stays in each group and the next beam; `group` numbers the groups from 0, `beam` has one of each."""
    n = len(beam)
    best, worst = np.full(n, -np.inf), np.full(n, np.inf)
    np.maximum.at(best, group, score)
    np.minimum.at(worst, group, score)
    count = np.bincount(group, minlength=n)
    limit = best - beam
    after = np.where(count > most, beam, np.minimum(width, beam * GROWTH))
    low = np.maximum(worst, limit)
    step = np.where(count > most, (best - low) / (BINS - 1), 0.0)
    live = (score >= limit[group]) & (step[group] > 0)
    kept = np.bincount(group[live], minlength=n)
    full = np.flatnonzero(kept > most)
    if len(full):
        place = np.full(n, -1)
        place[full] = np.arange(len(full))
        rows = np.flatnonzero(live & (place[group] >= 0))
        at = np.minimum((score[rows] - low[group[rows]]) / step[group[rows]], BINS - 1).astype(np.int64)
        bins = np.bincount(place[group[rows]] * BINS + at, minlength=len(full) * BINS).reshape(-1, BINS)
        few = kept[full][:, None] - np.cumsum(bins[:, : BINS - 1], 1) < most
        cut = np.where(few.any(1), few.argmax(1), BINS - 2)
        limit[full] = np.minimum(low[full] + (cut + 1) * step[full], best[full])
        after[full] = np.minimum(best[full] - limit[full], width)
    return limit, after


def frame_beams(tokens: DataFrame, width: float, most: int) -> DataFrame:
    """utt, frame, beam, least and kept: the beam of each frame, the least score that stays, and how many do.

    `tokens` has utt, frame and score. A frame's beam depends on the frame before, so an utterance is
    one group; a task holds it whole.
    """

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        frame, score = np.asarray(table.column("frame")), np.asarray(table.column("score"), float)
        starts = np.concatenate([[0], np.flatnonzero((np.diff(frame) != 0) | np.isin(np.arange(1, len(frame)), begins)) + 1, [len(frame)]])
        first = np.searchsorted(starts, begins)  # frames of utterance u: first[u] .. first[u + 1] - 1
        beams, least, kept = (np.zeros(len(starts) - 1) for _ in range(3))
        beam = np.full(len(begins) - 1, width)
        for t in range(int(np.diff(first).max(initial=0))):
            live = np.flatnonzero(first[:-1] + t < first[1:])
            at = first[live] + t
            sizes = starts[at + 1] - starts[at]
            rows = np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            group = np.repeat(np.arange(len(live)), sizes)
            limit, after = histogram_limits(group, score[rows], beam[live], width, most)
            beams[at], least[at] = beam[live], limit
            kept[at] = np.bincount(group, score[rows] >= limit[group], len(live))
            beam[live] = after
        take = pa.array(starts[:-1])
        return pa.table([table.column("utt").take(take), table.column("frame").take(take), pa.array(beams), pa.array(least), pa.array(kept.astype(np.int64))], names=["utt", "frame", "beam", "least", "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    rows = tokens.select("utt", "frame", F.col("score").cast("double").alias("score"))
    return map_groups(rows, "utt", ["frame"], run, f"utt {kinds['utt']}, frame {kinds['frame']}, beam double, least double, kept long")


def histogram_prune(tokens: DataFrame, group: str, score: str, beams: DataFrame, width: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The tokens of one frame that stay, and (group, beam) for the next frame.

    `beams` has group and beam; a group without one has the full width. Best scores, counts and bins are
    combined before they are shuffled; a group is BINS rows at most where its bins meet.
    """
    rows = tokens.withColumns({"_g": F.col(group), "_s": F.col(score)})
    ends = rows.groupBy("_g").agg(F.max("_s").alias("_best"), F.min("_s").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    ends = ends.join(beams.select(F.col(group).alias("_b"), F.col("beam").alias("_beam")), F.col("_g").eqNullSafe(F.col("_b")), "left").drop("_b")
    ends = ends.withColumn("_beam", F.coalesce("_beam", F.lit(width)))
    ends = ends.withColumn("_low", F.greatest("_worst", F.col("_best") - F.col("_beam")))
    ends = ends.withColumn("_step", F.when(F.col("_n") > most, (F.col("_best") - F.col("_low")) / (BINS - 1)).otherwise(0.0))
    over = ends.where("_step > 0").select(F.col("_g").alias("_o"), "_low", "_step", "_best")
    live = rows.select("_g", "_s").join(over, F.col("_g").eqNullSafe(F.col("_o"))).where("_s >= _low")
    bins = live.groupBy("_g", F.least(F.floor((F.col("_s") - F.col("_low")) / F.col("_step")), F.lit(BINS - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")
    left = F.sum("_c").over(w) - F.sum("_c").over(w.orderBy("_bin"))
    cut = bins.select("_g", "_bin", F.sum("_c").over(w).alias("_kept"), left.alias("_left")).where(f"_kept > {most}")
    cuts = cut.groupBy(F.col("_g").alias("_o")).agg(F.coalesce(F.min(F.when((F.col("_left") < most) & (F.col("_bin") < BINS - 1), F.col("_bin"))), F.lit(BINS - 2)).alias("_cut"))
    ends = ends.join(cuts, F.col("_g").eqNullSafe(F.col("_o")), "left").drop("_o")
    least = F.when(F.col("_cut").isNotNull(), F.least(F.col("_low") + (F.col("_cut") + 1) * F.col("_step"), F.col("_best"))).otherwise(F.col("_best") - F.col("_beam"))
    after = F.when(F.col("_cut").isNotNull(), F.least(F.col("_best") - least, F.lit(width))).when(F.col("_n") > most, F.col("_beam")).otherwise(F.least(F.lit(width), F.col("_beam") * GROWTH))
    limits = ends.select(F.col("_g").alias("_o"), least.alias("_least"), after.alias("beam"))
    kept = rows.join(limits, F.col("_g").eqNullSafe(F.col("_o"))).where("_s >= _least").select(*tokens.columns)
    return kept, limits.select(F.col("_o").alias(group), "beam")
