"""Functions over whole groups of rows, many groups to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, dealt: bool = False) -> DataFrame:
    """Apply `fn` to tables of whole groups, sorted, with the rows at which groups begin and the end.

    Rows are dealt by `key` once, and not at all where they are `dealt`: where a key's rows are in one partition, as
    behind `repartition(key)`, windows by it, or another call. Groups share calls, so small ones cost little;
    a group that arrives in several batches is put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def call(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            yield from fn(table.combine_chunks(), begins).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(key)[batch.num_rows - 1]
            if held[0].column(key)[0] == last:
                continue
            table = pa.Table.from_batches(held)
            same = table.column(key).combine_chunks()
            n = table.num_rows
            cut = n - 1
            while cut > 0 and same[cut - 1] == last:
                cut -= 1
            yield from call(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from call(pa.Table.from_batches(held))

    rows = df if dealt else df.repartition(key)
    return rows.sortWithinPartitions(key, *order).mapInArrow(run, schema)
