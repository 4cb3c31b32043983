"""Any feature graph over a stream of frames.

A stateful operator turns frames that arrive into stretches: frames whose context is there, with that context. The
graph is applied to each micro-batch's stretches as it is to the blocks of a table, so its modules, windows
and borders are the same in both, and chained modules cost one state: the base frames of twice the graph's context.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.plans.feature_graph import FeatureGraph

from .buffers import Buffer, milliseconds


def stretches(frames: DataFrame, context: int, patience: str = "10 minutes") -> DataFrame:
    """utt, block, frame, own, x of a stream with utt, frame, x and closed (true on the last frame of an utterance).

    A block is a run of frames that became ready together, named by its first one: these are `own`, and `context` frames on
    both sides are with them. The first and last frames of an utterance are repeated outside. `patience` is a
    stretch of processing time in words after which a silent utterance is closed.
    """
    wait = milliseconds(patience)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, buffer = pickle.loads(state.get[0]) if state.exists else (0, Buffer())
        for pdf in batches:
            buffer.add(pdf, "x")
        if state.hasTimedOut:
            buffer.last = buffer.end - 1
        over = buffer.is_whole() or state.hasTimedOut
        end = buffer.end if over else buffer.end - context
        rows = []
        if end > at:
            # outside of the utterance its first and last frames
            place = lambda f: min(max(f, 0), buffer.end - 1) - buffer.first
            rows = [(key[0], at, f, at <= f < end, buffer.row[place(f)].tolist()) for f in range(at - context, end + context)]
            at = end
        if over:
            state.remove()
        else:
            buffer.forget(at - context)
            state.update((pickle.dumps((at, buffer)),))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["utt", "block", "frame", "own", "x"])

    kind = frames.schema["utt"].dataType.simpleString()
    narrow = frames.select("utt", "frame", F.col("x").cast("array<double>").alias("x"), "closed")
    return narrow.groupBy("utt").applyInPandasWithState(step, f"utt {kind}, block int, frame int, own boolean, x array<double>", "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_graph(frames: DataFrame, graph: FeatureGraph, dim: int, write: Callable[[DataFrame, int], None], patience: str = "10 minutes") -> DataStreamWriter:
    """A writer that gives utt, frame and x of each micro-batch's ready frames, with the batch's number, to `write`, which writes them once."""

    def each(batch: DataFrame, number: int) -> None:
        def work() -> None:
            out, _ = graph.apply_padded(batch, dim)
            write(out.where("own").select("utt", "frame", "x"), number)

        # the plan of a deep graph needs the whole stack of a thread, and the stream's own has most of its taken
        with ThreadPoolExecutor(1) as thread:
            thread.submit(work).result()

    return stretches(frames, graph.context(), patience).writeStream.outputMode("append").foreachBatch(each)
