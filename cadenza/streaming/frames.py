"""Features of frames that arrive as a stream: windows per utterance, with frames out of order or late.

State per utterance holds the frames that a later output still needs. A frame's output
appears when its right context is there, so it is late by the width; the first and
last frames are repeated at the borders, the last one when the utterance is closed.
An utterance that is neither closed nor continued for some time is closed at the last frame up to
which it is whole, so that no state stays for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "utt long, frame int, x array<double>"
STATE = "first int, at int, last int, dim int, xs array<double>, late array<int>, late_xs array<double>"
#: Of each kind the output of the frames left and right of one (2 width + 1 rows).
WINDOWS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "delta": lambda x, w: np.arange(-w, w + 1) @ x * 3 / (w * (w + 1) * (2 * w + 1)),
    "mean_subtractor": lambda x, w: x[w] - x.mean(0),
    "concat": lambda x, w: x.ravel(),
}


def streaming_features(frames: DataFrame, kind: str = "delta", width: int = 2, patience: str = "10 minutes") -> DataFrame:
    """utt, frame, x of a stream with utt, frame, x and closed (true on the last frame of an utterance).

    A kind of WINDOWS is applied to `width` frames on both sides. `patience` is a stretch of processing time in words.
    """
    window = WINDOWS[kind]
    number, unit = patience.split()
    wait = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, at, last, dim, xs, late, late_xs = state.get if state.exists else (0, 0, -1, 0, [], [], [])
        values = {first + i: x for i, x in enumerate(np.asarray(xs, float).reshape(-1, max(dim, 1)))} if dim else {}
        waiting = dict(zip(late, np.asarray(late_xs, float).reshape(-1, max(dim, 1)), strict=True)) if dim else {}
        for pdf in batches:
            for frame, x, closed in zip(pdf["frame"], pdf["x"], pdf["closed"], strict=True):
                waiting[int(frame)] = np.asarray(x, float)
                last = int(frame) if closed else last
        end = max(values, default=-1) + 1
        while end in waiting:  # frames in a row are taken over, others wait
            values[end] = waiting.pop(end)
            if end == 0:
                values.update({-k: values[0] for k in range(1, width + 1)})
            end += 1
        if state.hasTimedOut:
            last = end - 1
        done = state.hasTimedOut or 0 <= last < end
        if done and end:
            values.update({last + k: values[last] for k in range(1, width + 1)})
            end = last + 1 + width
        rows = []
        while at + width < end:
            rows.append((key[0], at, window(np.stack([values[at + k] for k in range(-width, width + 1)]), width)))
            at += 1
        if done:
            state.remove()
        else:
            kept = sorted(f for f in values if f >= at - width)
            some = [*values.values(), *waiting.values()]
            flat = lambda names, of: [float(v) for f in names for v in of[f]]
            names = sorted(waiting)
            state.update((kept[0] if kept else 0, at, last, len(some[0]) if some else 0, flat(kept, values), names, flat(names, waiting)))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["utt", "frame", "x"])

    narrow = frames.select("utt", "frame", "x", "closed")
    return narrow.groupBy("utt").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def streaming_delta(frames: DataFrame, width: int = 2) -> DataFrame:
    """utt, frame, delta of a stream with utt, frame, value and closed."""
    rows = frames.select("utt", "frame", F.array(F.col("value").cast("double")).alias("x"), "closed")
    return streaming_features(rows, "delta", width).select("utt", "frame", F.element_at("x", 1).alias("delta"))
