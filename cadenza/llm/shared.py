"""Helpers that the operators of this subpackage share: scratch tables, running sums, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python task handles at once; one longer text is handled alone.
CHUNK_BYTES = 2_000_000
#: Rows of a few numbers, and bytes of texts, that are worth a task and a file of their own.
PART_ROWS, PART_BYTES = 50_000, 4_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def in_parts(df: DataFrame, size: int, part: int = PART_ROWS) -> DataFrame:
    """`df` in no more partitions than `size` has parts of `part`, so that a small table is not written as many small files.

    A file costs the same however few rows it has; on a local disk some six processes are started for
    it, each of which has all memory of the JVM for a moment. Larger tables keep their partitions. `size` may be an estimate.
    """
    return df.coalesce(max(1, -(-size // part)))


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    Tables put() with keep=False go when drop() is called, which an operator does
    before it returns. Those that the returned DataFrame still reads stay until
    who reads it is done and calls `drop_scratch`, or leaves `passing_scratch`.
    """

    #: Every scratch folder that has not been deleted, in the order in which they were made.
    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.spent: list[str] = []
        Scratch.made.append(self)

    def put(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not keep:
            self.spent.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all that were not kept."""
        wanted = {f"{self.root}/{n}" for n in names} or set(self.spent)
        for path in wanted:
            self._delete(path)
        self.spent = [p for p in self.spent if p not in wanted]

    def delete(self) -> None:
        """Delete all tables, kept ones too."""
        self._delete(self.root)
        Scratch.made = [s for s in Scratch.made if s is not self]


def drop_scratch() -> None:
    """Delete what operators have stored for DataFrames that they returned; these can't be read after that."""
    for scratch in list(Scratch.made):
        scratch.delete()


@contextmanager
def passing_scratch() -> Iterator[None]:
    """Delete at the end what operators stored inside: what they returned has been written elsewhere by then."""
    before = set(map(id, Scratch.made))
    yield
    for scratch in [s for s in Scratch.made if id(s) not in before]:
        scratch.delete()


def fresh(name: str, *tables: DataFrame) -> str:
    """`name`, made longer until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest(*cols: str) -> Column:
    """16 bytes that tell rows apart that differ in these columns, null or not."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in cols]
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def running_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], sums: dict[str, tuple[str, str]], wholes: dict[str, str] | None = None) -> DataFrame:
    """Exclusive running aggregates within `keys`, spread over many tasks.

    `bucket` must not decrease in `order`. Each (keys, bucket) is one window group,
    so a key that holds most rows is split over its buckets; totals of earlier
    buckets are added by a join. `sums` maps a new column to (aggregate, column),
    the aggregate being sum or bit_xor; a running value of nothing is 0. `wholes`
    names columns for the key's whole aggregate of some of these.
    """
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}
    plus = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    cols = [*keys, bucket]
    totals = df.groupBy(*cols).agg(*[agg[kind](c).alias(f"_t_{name}") for name, (kind, c) in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in cols],
        *[F.coalesce(agg[kind](f"_t_{name}").over(before), F.lit(0).cast("long")).alias(f"_o_{name}") for name, (kind, _) in sums.items()],
        *[agg[sums[name][0]](f"_t_{name}").over(Window.partitionBy(*keys)).alias(new) for name, new in (wholes or {}).items()],
    )
    on = None
    for c in cols:
        same = df[c].eqNullSafe(offsets[f"_k_{c}"])
        on = same if on is None else on & same
    inside = Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, on)
    out = out.withColumns({name: plus[kind](F.col(f"_o_{name}"), F.coalesce(agg[kind](c).over(inside), F.lit(0).cast("long"))) for name, (kind, c) in sums.items()})
    return out.drop(*[f"_k_{c}" for c in cols], *[f"_o_{name}" for name in sums])


def hash_share(*cols: str) -> Column:
    """A number from 0 to 1 by which rows can be sampled: those below limit / count are about `limit`, wherever they are."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) / F.lit(float(1 << 63))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece have about `limit` bytes, or are one text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).cumsum()
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def release_memory() -> None:
    """Give memory that a task has freed back to the system: Python workers live on, and their heaps would add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """Apply `fn` to chunks of rows of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, column):
            yield fn(piece)
        release_memory()

    return df.mapInArrow(run, schema)
