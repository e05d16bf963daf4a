"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table below ``spark.checkpoint.dir`` and reading it again. The
files survive the loss of any executor, and a recomputed task reads the rows that every other task has read.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrasift.session import shared_root, ship

#: Rows of a batch that a Python worker gets at a time: texts may be long, and the default of 10,000 holds many MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers, and bound what they are sent at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def whole_numbers(df: DataFrame, name: str) -> None:
    """Refuse a column of ids that aren't whole numbers of 64 bits at most: a cast would turn them into nulls."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{name} must be a whole number, but is {kind.simpleString()}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


class Scratch:
    """Names and writes the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        self.folder = shared_folder(spark)
        self.written = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again with the same schema."""
        path = f"{self.folder}/{self.written:03d}"
        self.written += 1
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def grouping(self, groups: int) -> Iterator[None]:
        """Let tables that are written meanwhile group up to ``groups`` lists in a task before they are sorted instead."""
        name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(groups))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def drop(self) -> None:
        """Delete everything written so far; only for callers whose results no longer depend on it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
