"""Frames of an utterance that arrive in any order, put in a row again.

A buffer holds what a later output still needs and what came too early. An utterance is whole when the frame that
is marked as closed has come and none before it lacks; one that stays silent for too long ends at the last frame
up to which it is whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

#: Milliseconds of the units of a stretch of time in words.
UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000}


def milliseconds(patience: str) -> int:
    number, unit = patience.split()
    return int(number) * UNITS[unit.rstrip("s")]


@dataclass
class Buffer:
    """Frames `first` .. in a row, those that wait for one before them, and the last frame of the utterance, if it is known."""

    first: int = 0
    last: int = -1
    row: list[np.ndarray] = field(default_factory=list)
    waiting: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def end(self) -> int:
        return self.first + len(self.row)

    def add(self, pdf: pd.DataFrame, column: str) -> None:
        """Take frames (frame, `column`, closed); one that was taken before is passed over."""
        for frame, x, closed in zip(pdf["frame"].tolist(), pdf[column], pdf["closed"], strict=True):
            if closed:
                self.last = int(frame)
            if frame >= self.end:
                self.waiting.setdefault(int(frame), np.asarray(x, float))
        while self.end in self.waiting and (self.last < 0 or self.end <= self.last):
            self.row.append(self.waiting.pop(self.end))

    def is_whole(self) -> bool:
        return 0 <= self.last < self.end

    def forget(self, before: int) -> None:
        """Drop frames before a number."""
        cut = min(max(0, before - self.first), len(self.row))
        self.row, self.first = self.row[cut:], self.first + cut
