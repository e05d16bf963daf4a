"""Point-cloud operators: filters, deterministic sampling, gridding and hole filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.functions.geometry import cell

GROUND = 2
RESETTABLE = ("intensity", "return_number", "number_of_returns", "scan_direction_flag", "scan_angle_rank", "user_data", "point_source_id", "gps_time")


def by_hash(key: str, seed: str) -> list[Column]:
    """An order that looks random, is the same on every run and in every layout, and has no ties between keys."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), F.col(key)]


def colored(points: DataFrame) -> DataFrame:
    """Points whose three colour channels are all set."""
    return points.where("red <> 0 and green <> 0 and blue <> 0")


def of_class(points: DataFrame, code: int, keep: bool = True) -> DataFrame:
    """Points of a class, or those of all others."""
    return points.where((F.col("classification") == code) == F.lit(keep))


def zero_fields(points: DataFrame, fields: tuple[str, ...] = RESETTABLE) -> DataFrame:
    """Scalar dimensions set to zero; those that the cloud lacks are ignored."""
    return points.withColumns({f: F.lit(0).cast(points.schema[f].dataType) for f in fields if f in points.columns})


def reclass_near(points: DataFrame, sites: DataFrame, half: float = 4.0, source: int = 5, target: int = 11) -> DataFrame:
    """Points of class ``source`` in a closed square around any site (sx, sy) become ``target``.

    Sites are joined through the grid cells that their squares touch, so a point meets nearby sites only.
    """
    side = 2 * half
    near = sites.select("sx", "sy", F.explode(F.sequence(cell(F.col("sx") - half, side), cell(F.col("sx") + half, side))).alias("cx"))
    near = near.select("sx", "sy", "cx", F.explode(F.sequence(cell(F.col("sy") - half, side), cell(F.col("sy") + half, side))).alias("cy"))
    keyed = points.withColumn("cx", cell("x", side)).withColumn("cy", cell("y", side))
    inside = (F.abs(F.col("x") - F.col("sx")) <= half) & (F.abs(F.col("y") - F.col("sy")) <= half)
    hit = keyed.where(F.col("classification") == source).join(near, ["cx", "cy"]).where(inside).select("pt_key").distinct()
    hit = hit.withColumn("hit", F.lit(True))
    return points.join(hit, "pt_key", "left").withColumn("classification", F.when(F.col("hit"), target).otherwise(F.col("classification"))).drop("hit")


def sample_fraction(points: DataFrame, fraction: float, key: str = "pt_key", seed: str = "s") -> DataFrame:
    """Exactly floor(n * fraction) points, without replacement.

    The threshold is found by rank in the hash order within hash ranges: a range is taken whole, left out whole, or, for
    the one at the limit, ranked; so no task orders all points.
    """
    spread = points.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))).withColumn("_b", F.substring("_h", 1, 3))
    counts = spread.groupBy("_b").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    wanted, before, last = int(total * fraction), 0, None
    for r in counts.orderBy("_b").collect():  # 4096 ranges at most
        if before + r["count"] > wanted:
            last = r["_b"]
            break
        before += r["count"]
    if last is None:
        return spread.drop("_h", "_b")
    edge = spread.where(F.col("_b") == last).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return spread.where(F.col("_b") < last).drop("_h", "_b").unionByName(edge.where(F.col("_n") <= wanted - before).drop("_h", "_b", "_n"))


def cap_per_tile(points: DataFrame, most: int = 100, size: float = 1.0, groups: tuple[str, ...] = (), key: str = "pt_key", seed: str = "t") -> DataFrame:
    """At most ``most`` points in every square tile (and group); the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*groups, cell("x", size), cell("y", size)).orderBy(*by_hash(key, seed))
    return points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def cap_above(points: DataFrame, above: int, to: int, group: str, key: str = "pt_key", seed: str = "c") -> DataFrame:
    """Groups of more than ``above`` points are sampled down to ``to``."""
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    w = Window.partitionBy(group).orderBy(*by_hash(key, seed))
    few = points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= above).join(sizes, group)
    return few.where((F.col("_all") <= above) | (F.col("_n") <= to)).drop("_n", "_all")


def thin_clean(points: DataFrame, most: int = 100) -> DataFrame:
    """Ground and other points capped per tile separately, then those without colour dropped."""
    marked = points.withColumn("is_ground", F.col("classification") == GROUND)
    return colored(cap_per_tile(marked, most, groups=("is_ground",))).drop("is_ground")


def extent(points: DataFrame, *by: str) -> DataFrame:
    """The bounding box of each group's points; from row-group statistics alone where the source has them."""
    return points.groupBy(*by).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def grid(points: DataFrame, size: float, *aggregates: Column) -> DataFrame:
    """Aggregates of the points of every occupied cell (ix, iy); partial sums are formed before the shuffle."""
    return points.groupBy(cell("x", size).alias("ix"), cell("y", size).alias("iy")).agg(*aggregates)


def histogram(points: DataFrame, bounds: DataFrame, size: float = 1.0) -> DataFrame:
    """Points per cell of a grid that starts at the least coordinates; the last cells include their far edges."""
    last = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / size) - 1, F.lit(0))
    keyed = points.join(F.broadcast(bounds))  # one row
    ix = F.least(cell("x", size, F.col("xmin")), last("xmin", "xmax"))
    iy = F.least(cell("y", size, F.col("ymin")), last("ymin", "ymax"))
    return keyed.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def all_cells(cells: DataFrame) -> DataFrame:
    """Every cell of the range that occupied cells span; n is 0 where there is none."""
    a, b, c, d = cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    tall, number = (d - c + 1, (b - a + 1) * (d - c + 1)) if a is not None else (1, 0)
    dense = cells.sparkSession.range(number).select((F.floor(F.col("id") / tall) + (a or 0)).alias("ix"), (F.col("id") % tall + (c or 0)).alias("iy"))
    return dense.join(cells, ["ix", "iy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def low_density(cells: DataFrame, threshold: int, include_empty: bool = False) -> DataFrame:
    """Cells with fewer points than the threshold; empty ones only if asked for."""
    dense = all_cells(cells) if include_empty else cells
    return dense.withColumn("low", (F.col("n") < threshold) if include_empty else (F.col("n") > 0) & (F.col("n") < threshold))


def fill_nearest(cells: DataFrame, value: str, reach: int) -> DataFrame:
    """Empty cells between occupied ones take the value of the nearest, within ``reach`` cells; the rest stay away.

    Every occupied cell offers its value to the cells around it, and min_by keeps the nearest (ties: row, then column).
    """
    offer = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = cells.select("ix", "iy", value, offer.alias("dx")).select("ix", "iy", value, "dx", offer.alias("dy"))
    spread = spread.where(F.col("dx") ** 2 + F.col("dy") ** 2 <= reach * reach)
    near = spread.groupBy((F.col("ix") + F.col("dx")).alias("tx"), (F.col("iy") + F.col("dy")).alias("ty")).agg(
        F.min(F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d"), F.col("iy"), F.col("ix"), F.col(value))).alias("best")
    )
    span = cells.agg(F.min("ix").alias("a"), F.max("ix").alias("b"), F.min("iy").alias("c"), F.max("iy").alias("e"))
    near = near.join(F.broadcast(span)).where("tx between a and b and ty between c and e")
    return near.select(F.col("tx").alias("ix"), F.col("ty").alias("iy"), F.col(f"best.{value}").alias(value), (F.col("best.d") > 0).alias("filled"))
