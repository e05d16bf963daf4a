"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.session import shared_root


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and output, in the shared checkpoint folder where one is set."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def gap_sessions(rows: DataFrame, key: str, time: str, gap_us: int, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: (key, start, last, n), which end after a gap of more than ``gap_us`` microseconds.

    A session window ends where the gap is reached, so it is made a microsecond longer than the gap. State of sessions
    that the watermark has passed is dropped.
    """
    window = F.session_window(time, f"{gap_us // 1_000_000} seconds {gap_us % 1_000_000 + 1} microseconds")
    out = rows.withWatermark(time, late).groupBy(key, window.alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "start", "last", "n")


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """A stream of times (ts), written by ``beat``, at which nothing happens but that time goes on: joined to rows by a union,
    they let a watermark pass the last of them."""
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp").parquet(path)


def beat(spark: SparkSession, path: str, ts) -> None:
    """Tell a stream of heartbeats that the time is ``ts``."""
    spark.createDataFrame([(ts,)], "ts timestamp").coalesce(1).write.mode("append").parquet(path)


def run_available(stream: DataFrame, to: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process all input that is there, then stop. A rerun with the same ``to`` goes on after what is done."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", f"{to}/rows")
    query = writer.start()
    query.awaitTermination()


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended to the files of a folder, as an unbounded table (value)."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", 1000).load(path)
