"""Operators over ordered rows: headings, gaps, sessions, intervals, polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.functions.geometry import azimuth, distance


def heading_band(rows: DataFrame, key: str, order: list[str], width: float, yaw: str = "yaw") -> DataFrame:
    """Rows whose heading is within ``width`` of the first of its key, or of the opposite direction."""
    start = rows.groupBy(key).agg(F.min_by(yaw, F.struct(*order)).alias("_y0"))
    start = start.withColumn("_y1", F.when(F.col("_y0") > 0, F.col("_y0") - 180).otherwise(F.col("_y0") + 180))
    near = lambda c: F.col(yaw).between(F.col(c) - width, F.col(c) + width)
    return rows.join(start, key).where(near("_y0") | near("_y1")).drop("_y0", "_y1")


def _gaps(rows: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_gap", F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(*order)))


def sessions(rows: DataFrame, key: str, time: str, order: list[str], gap) -> DataFrame:
    """``rows`` with a session number per key from 0; a new one starts after a gap of more than ``gap``."""
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("_gap") > gap, 1).otherwise(0)
    return _gaps(rows, key, time, order).withColumn("session", F.sum(new).over(running).cast("long")).drop("_gap")


def breakpoints(rows: DataFrame, key: str, time: str, order: list[str], gap) -> DataFrame:
    """The first and last time of each key, and both sides of every gap of more than ``gap``; each once."""
    gaps = _gaps(rows, key, time, order)
    sides = F.when(F.col("_gap") > gap, F.array(F.col(time), F.col(time) - F.col("_gap")))
    inner = gaps.select(key, F.explode(sides).alias(time))
    ends = rows.groupBy(key).agg(F.array(F.min(time), F.max(time)).alias("_e")).select(key, F.explode("_e").alias(time))
    return inner.union(ends).distinct()


def intervals(breaks: DataFrame, key: str, time: str) -> DataFrame:
    """Consecutive breakpoints as (key, start_us, end_us)."""
    end = F.lead(time).over(Window.partitionBy(key).orderBy(time))
    return breaks.select(key, F.col(time).alias("start_us"), end.alias("end_us")).where("end_us is not null")


def in_intervals(rows: DataFrame, spans: DataFrame, key: str, time: str) -> DataFrame:
    """Rows within each closed interval of their key; a row on a shared end is in both."""
    return rows.join(spans, key).where(F.col(time).between(F.col("start_us"), F.col("end_us")))


def azimuths(vertices: DataFrame) -> DataFrame:
    """Vertices with the azimuth of the way to them; null at the first and along an axis."""
    w = Window.partitionBy("fid").orderBy("vertex_ind")
    return vertices.withColumn("azimuth", azimuth(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))


def direction_changes(vertices: DataFrame, degrees: float) -> DataFrame:
    """Vertices with ``section``: whether the way from them turns by more than ``degrees``, in whole degrees."""
    after = F.lead("azimuth").over(Window.partitionBy("fid").orderBy("vertex_ind"))
    return azimuths(vertices).withColumn("section", F.coalesce(F.abs(F.floor(after) - F.floor("azimuth")) > degrees, F.lit(False)))


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices as segments, with their length and the length before them."""
    w = Window.partitionBy("fid").orderBy("vertex_ind")
    out = vertices.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("nx is not null")
    out = out.withColumn("d", distance("x", "y", "nx", "ny"))
    return out.withColumn("at", F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def polyline_lengths(vertices: DataFrame) -> DataFrame:
    w = Window.partitionBy("fid").orderBy("vertex_ind")
    step = vertices.withColumn("d", distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))
    return step.groupBy("fid").agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def sample_lines(vertices: DataFrame, step: float) -> DataFrame:
    """max(2, floor(L / step) + 1) points at even distances along each line, without its end; none on a line of length 0.

    Each segment makes the points that fall on it, so a long line is spread like any other rows.
    """
    parts = segments(vertices)
    lines = parts.groupBy("fid").agg(F.sum("d").alias("len")).where("len > 0")
    lines = lines.withColumn("n", F.greatest(F.lit(2), F.floor(F.col("len") / step) + 1).cast("long"))
    w = Window.partitionBy("fid").orderBy("at", "vertex_ind")
    parts = parts.where("d > 0").withColumn("until", F.lead("at").over(w)).join(lines, "fid")
    first = F.ceil(F.col("at") * F.col("n") / F.col("len")) - 1
    last = F.coalesce(F.ceil(F.col("until") * F.col("n") / F.col("len")) + 1, F.col("n") - 1)
    spread = parts.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.col("n") - 1).cast("long"))))
    spread = spread.withColumn("pos", F.col("len") * F.col("k") / F.col("n"))
    spread = spread.where((F.col("at") <= F.col("pos")) & (F.col("until").isNull() | (F.col("pos") < F.col("until"))))
    t = (F.col("pos") - F.col("at")) / F.col("d")
    return spread.select("fid", "k", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y"))
