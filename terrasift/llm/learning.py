"""Bounded labelled samples for the classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)).cast("int")


def sample_ids(labelled: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows (id as text, label) of each label, by a hash of the id, with ``weight``.

    The weights restore each class to its size in ``labelled``. An id with several labels takes the greatest; rows
    without id or label don't count. Spark limits each class before it is shuffled, so a common class is no hot spot.
    """
    labelled = labelled.select(F.col("id").cast("string").alias("id"), "label")
    one = labelled.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    sizes = F.broadcast(one.groupBy("label").agg(F.count(F.lit(1)).alias("all")))  # a row for each class
    # a share of each class by hash, a little more than is wanted, so that few rows are ranked
    share = F.least(F.lit(1.0), (per_class * 1.3 + 50) / F.col("all"))
    near = one.join(sizes, "label").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("id"), F.lit(1_000_000)), "id"))
    few = near.withColumn("nth", nth).where(F.col("nth") <= per_class)
    return few.select("id", "label", (F.col("all") / F.least(F.col("all"), F.lit(per_class))).alias("weight"))


def with_texts(sample: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``sample`` with the texts of its ids. It has a bounded number of rows, so it is what is sent to all tasks."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sample), "id")
