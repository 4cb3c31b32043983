"""Decoding of utterances whose frames arrive as a stream.

The state of an utterance is its tokens, the ends of words that they can go back to, and frames that came too
early. Each micro-batch advances the tokens by the frames that are in a row and says what the best token has behind it;
when the utterance is closed the result is that of `search.decode`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.search import ZERO, Decoder

from .buffers import Buffer, milliseconds


def streaming_decode(frames: DataFrame, decoder: Decoder, patience: str = "10 minutes") -> DataFrame:
    """utt, frames, words, score, final of a stream with utt, frame, scores and closed (true on the last frame of an utterance).

    `frames` counts those that were decoded. Rows with final false are partial: they may change. An utterance that is silent for
    longer than `patience`, a stretch of processing time in words, is closed where it is whole.
    """
    wait = milliseconds(patience)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tokens, buffer = pickle.loads(state.get[0]) if state.exists else (0, decoder.begin(1), Buffer())
        before = at
        for pdf in batches:
            buffer.add(pdf, "scores")
        while at < buffer.end:
            decoder.advance(tokens, at, buffer.row[at - buffer.first][None])
            tokens.reclaim()
            at += 1
        buffer.forget(at)
        rows = []
        if buffer.is_whole() or state.hasTimedOut:
            words, score = decoder.finish(tokens, at, np.array([True])).get(0, ((), ZERO))
            rows.append((key[0], at, " ".join(words), float(score), True))
            state.remove()
        else:
            if at > before:
                words, score = decoder.so_far(tokens).get(0, ((), ZERO))
                rows.append((key[0], at, " ".join(words), float(score), False))
            state.update((pickle.dumps((at, tokens, buffer)),))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["utt", "frames", "words", "score", "final"])

    kind = frames.schema["utt"].dataType.simpleString()
    narrow = frames.select("utt", "frame", F.col("scores").cast("array<double>").alias("scores"), "closed")
    return narrow.groupBy("utt").applyInPandasWithState(step, f"utt {kind}, frames int, words string, score double, final boolean", "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
