"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: its share, by weight, of the mix, at most ``most`` times its own size; what
a capped source can't take is shared again by weight. A document of n words is to be copied target / source size times
on average. The whole part of that number is certain; the fraction is rounded dependently: two documents that are still
fractional transfer probability so that the expected words stay as they are, in a random direction that keeps each
document's own expectation, until one of the two is integral. A block of documents leaves one fractional residual at
most. Residuals of neighbouring blocks meet in a reduction tree, and at its root the one document that is left of each
source goes to the nearer whole number, so a source's words differ from its target by half a document at most; all
documents but that one keep their expectation.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def count_words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; null counts as empty."""
    # a run starts at a character that isn't white space and follows white space or nothing
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blank, " ", -1), lambda w: w != "")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with the weight of each source, in code-point order, null last.

    Ranks come from a range partitioning and the counts of its partitions, so no task sorts all sources.
    """
    parts = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = scratch.table(parts)
    counts = parts.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = parts.join(before, "part").withColumn("place", F.pmod(F.col("before") + place, F.lit(len(weights))).cast("int"))
    return ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1).alias("weight"))


def targets(sizes: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` times the source's size.

    Shares only grow as sources are capped, so each pass caps what is above its limit and shares the excess again; a
    pass is one aggregation, and only sums reach the driver.
    """
    ranked = scratch.table(ranked_sources(sizes, scratch, weights)).withColumn("limit", F.lit(most) * F.col("source_size"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:
        capped = F.col("limit") < F.lit(unit) * F.col("weight")
        held, open_ = ranked.agg(F.sum(F.when(capped, F.col("limit"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_:
            break
        now = (share * total - (held or 0.0)) / open_
        if now <= unit * (1 + 1e-12):
            break
        unit = now
    return ranked.select("source", "source_size", F.least("limit", F.lit(unit) * F.col("weight")).alias("target"))


def draw(seed: int, *key) -> float:
    """A number in [0, 1) that depends on the seed and the key alone."""
    return xxhash.xxh64_intdigest(repr(key), seed=seed) / 2**64


def pivotal(ids: list, sizes: list[int], p: list[float], seed: int, level: int, eps: float = 1e-9) -> list[float]:
    """The probabilities after dependent rounding: all 0 or 1 but for one at most.

    Each transfer keeps sum(size * p), and the expectation of every p.
    """
    p = [0.0 if x < eps else 1.0 if x > 1 - eps else x for x in p]
    held = None
    for i, x in enumerate(p):
        if not 0 < x < 1:
            continue
        if held is None:
            held = i
            continue
        j, a, b = held, float(sizes[held]), float(sizes[i])
        # words that j can give and i can take, and the other way round
        down, up = min(p[j] * a, (1 - x) * b), min((1 - p[j]) * a, x * b)
        moved = -down if draw(seed, level, ids[j], ids[i]) < up / (up + down) else up
        p[j], p[i] = p[j] + moved / a, x - moved / b
        for k in (j, i):
            p[k] = 0.0 if p[k] < eps else 1.0 if p[k] > 1 - eps else p[k]
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return p


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 1,
    block: int = 512,
    fan: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken.

    size is the number of words (null text: 0) and taken = copies * size. Texts without words take nothing and are
    copied once if their source is to be copied at all. A null source is a source, the last. Ids may be of any type. Draws
    depend on the seed and on ids, sizes, sources and texts only, so reruns agree, however the rows are dealt. Rows that
    repeat an id, or have none, are rounded one by one, in the order of their sizes and of a hash of their texts; rows
    that agree in all of these share their copies in any order. An empty table gives no rows. Other columns are not read.
    """
    out = _copies(docs, F.struct(F.lit(0)), id_col, text_col, source_col, share, most, weights, seed, block, fan)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _copies(docs, key: Column, id_col, text_col, source_col, share=1.5, most=2.0, weights=WEIGHTS, seed=1, block=512, fan=64) -> DataFrame:
    """(id, key, size, source_size, target, copies) of every row; ``key`` tells rows apart that agree in id and text."""
    scratch = Scratch(docs.sparkSession)
    # blocks by hash: a source of any size is split into blocks of bounded size, none of which depends on the layout
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("same"), key.alias("key"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("filled"))
    sums = scratch.table(sums)
    goal = scratch.table(targets(sums.select("source", "source_size"), scratch, share, most, weights).join(sums.select(F.col("source").alias("s"), "filled"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    rows = rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    rows = rows.withColumn("blocks", F.ceil(F.col("filled") / block)).withColumn(
        "block", F.pmod(F.xxhash64("id", "size", "same"), F.greatest("blocks", F.lit(1))).cast("long")
    )
    rows = scratch.table(rows.withColumn("p", F.col("rate") - F.floor("rate")))
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("same").cast("string"))
    parts = rows.where("size > 0").select("source", "block", "row", name.alias("name"), F.xxhash64("key").alias("tie"), "size", "p")
    schema = f"source {rows.schema['source'].dataType.simpleString()}, block long, row long, name string, tie long, size long, p double"
    level, depth, settled = parts, 0, []
    while True:
        level = scratch.table(level.groupBy("source", "block").applyInPandas(_rounding(seed, depth), schema))
        settled.append(level.where("p = 0 or p = 1").select("row", "p"))
        rest = level.where("p > 0 and p < 1")
        if level.agg(F.max("block")).first()[0] in (None, 0):
            break
        level = rest.withColumn("block", F.floor(F.col("block") / fan))
        depth += 1
    settled.append(rest.select("row", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p")))
    whole = settled[0]
    for x in settled[1:]:
        whole = whole.union(x)
    out = rows.join(whole.withColumnRenamed("p", "rounded"), "row", "left")
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.col("rounded")).otherwise(F.when(F.col("rate") > 0, 1).otherwise(0))
    return out.select("id", "key", "size", "source_size", "target", copies.cast("int").alias("copies"))


def _rounding(seed: int, level: int):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        # the longest come first: what follows is enough to make them integral, and the residual is a shorter document
        rows = rows.sort_values(["size", "name", "tie", "row"], ascending=[False, True, True, True]).reset_index(drop=True)
        rows["p"] = pivotal(rows["name"].tolist(), rows["size"].tolist(), rows["p"].tolist(), seed, level)
        return rows

    return rounded


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix copies it, with all their columns.

    A row is known by two 64-bit hashes of all its columns. Rows that agree in every column share the copies that the mix
    gives them together as evenly as whole numbers allow, which makes the same rows.
    """
    columns = docs.columns
    hashes = {"__a": F.xxhash64(*columns), "__b": F.xxhash64(F.lit("b"), *columns)}
    own = _copies(docs, F.struct(*(h.alias(n) for n, h in hashes.items())), id_col, text_col, source_col)
    counts = own.groupBy("key").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows")).where("__all > 0")
    joined = docs.withColumns(hashes).join(counts.select("key.*", "__all", "__rows"), [*hashes])
    # ordered as the join needs it anyway
    nth = F.row_number().over(Window.partitionBy(*hashes).orderBy("__a"))
    joined = joined.withColumn("__times", F.floor(F.col("__all") / F.col("__rows")) + (nth <= F.col("__all") % F.col("__rows")).cast("int")).where("__times > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times").cast("long")))).select(*columns)
