"""Cutting lineage in loops: checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint of `df` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cadenza-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Rounds:
    """Tables of a loop in the shared folder, each written once.

    They stay while a DataFrame may read them: until `drop`, or `drop_rounds` for all.
    """

    made: ClassVar[list[Rounds]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0
        Rounds.made.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        Rounds.made = [r for r in Rounds.made if r is not self]


def drop_rounds() -> None:
    """Delete the tables of all loops; DataFrames that they returned can't be read after that."""
    for rounds in list(Rounds.made):
        rounds.drop()
