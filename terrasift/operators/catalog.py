"""Operators over file lists and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.operators.lineage import cut

def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the number ``_p`` of their range.

    The ranges are found by sampling, so the result is kept: what is counted of a range holds for it later.
    """
    return cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _before(parts: DataFrame, total: Column) -> Column:
    """What the ranges before a row's own have in total; one number for each range reaches the driver."""
    sums = {r["_p"]: r["_t"] for r in parts.groupBy("_p").agg(total.alias("_t")).collect()}
    first, at = [], 0
    for p in sorted(sums):
        first += [F.lit(p), F.lit(at).cast("long")]
        at += sums[p]
    return F.element_at(F.create_map(*first), F.col("_p")) if first else F.lit(0).cast("long")


def numbered(rows: DataFrame, *order: str, name: str = "_n") -> DataFrame:
    """``rows`` with their place from 0 in ascending ``order``; no task sorts them all."""
    parts = in_order(rows, *order)
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn(name, place + _before(parts, F.count(F.lit(1)))).drop("_p")


def running_total(rows: DataFrame, value: str, *order: str, by: str | None = None, name: str = "running") -> DataFrame:
    """``rows`` with the sum of a whole-numbered ``value`` up to and with themselves in ascending ``order``, of all rows or of
    those of each ``by``, however many rows a single one has."""
    keys = [by] if by else []
    parts = in_order(rows, *keys, *order)
    own = F.sum(value).over(Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not by:
        return parts.withColumn(name, own + _before(parts, F.sum(value))).drop("_p")
    # only the first key of a range can have rows in earlier ones; three numbers for each range reach the driver
    ends = parts.groupBy("_p").agg(F.min(by).alias("_a"), F.max(by).alias("_b"))
    last = parts.join(F.broadcast(ends), "_p").where(F.col(by).eqNullSafe(F.col("_b"))).groupBy("_p").agg(F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.sum(value).alias("_t"))
    held, carried, before = 0, [], None
    for r in sorted(last.collect(), key=lambda r: r["_p"]):
        begins = held if before == (r["_a"],) else 0
        if begins:
            carried.append((r["_p"], r["_a"], begins))
        held, before = r["_t"] + (begins if r["_a"] == r["_b"] else 0), (r["_b"],)
    if not carried:
        return parts.withColumn(name, own).drop("_p")
    kind = rows.schema[by].dataType.simpleString()
    add = rows.sparkSession.createDataFrame(carried, f"_p int, _k {kind}, _c long").withColumnRenamed("_k", by)
    return parts.withColumn("_own", own).join(F.broadcast(add), ["_p", by], "left").withColumn(name, F.col("_own") + F.coalesce("_c", F.lit(0))).drop("_p", "_own", "_c")


def positional_join(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Row k of one table beside row k of the other."""
    return numbered(left, left_order).join(numbered(right, right_order), "_n").drop("_n")


def chunked(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with the number of their chunk of ``size`` rows in ascending ``order``."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def list_lookup(rows: DataFrame, key: str, lists: str, names: DataFrame, name: str) -> DataFrame:
    """For each key the names of the elements of its comma-separated list, in the list's order; unknown ones are left out."""
    parts = rows.select(key, F.posexplode(F.split(lists, ",")).alias("pos", "part"))
    found = parts.withColumn("element", F.expr("try_cast(part as bigint)")).join(names, "element")
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "element", name))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x[name]), ",").alias("found"))


def contains_join(rows: DataFrame, text: str, tiles: DataFrame, tile: str) -> DataFrame:
    """Pairs where the text contains the tile's name.

    They are matched through the substrings of the texts that have a tile's length: an equi-join, whose rows grow with the
    texts and not with the product.
    """
    lengths = [r["n"] for r in tiles.select(F.length(tile).alias("n")).distinct().collect()]
    if not lengths:
        return rows.join(tiles, F.lit(False))
    cut = F.explode(F.array_distinct(F.concat(*(_substrings(text, n) for n in lengths))))
    return rows.withColumn("_t", cut).join(tiles.withColumn("_t", F.col(tile)), "_t").drop("_t")


def _substrings(text: str, n: int):
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.col(text).substr(i, F.lit(n)))


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, status) of two listings (name, hash): only_in_a, only_in_b, same or changed."""
    a, b = a.select("name", F.col("hash").alias("ha")), b.select("name", F.col("hash").alias("hb"))
    status = F.when(F.col("hb").isNull(), "only_in_a").when(F.col("ha").isNull(), "only_in_b").when(F.col("ha") == F.col("hb"), "same").otherwise("changed")
    return a.join(b, "name", "full").select("name", status.alias("status"))


def inverse_cdf(rows: DataFrame, key: str, picks: int) -> DataFrame:
    """For each key the rows (w, upto: weight and running total) that hold ``picks`` evenly spread shares of its total.

    Every row makes the picks that fall into its own share, so no pick is joined with rows that don't hold it.
    """
    totals = rows.groupBy(key).agg(F.max("upto").alias("total"))
    pick = lambda k: F.floor(F.col("total") * (2 * k + 1) / (2 * picks))
    holds = lambda k: (F.col("upto") > pick(k)) & (F.col("upto") - F.col("w") <= pick(k))
    return rows.join(totals, key).withColumn("k", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(picks - 1).cast("long")), holds)))
