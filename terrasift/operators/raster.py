"""Raster operators on cells: a raster is a table (r, c, one column per band), null is no data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.operators.lineage import cut
from terrasift.session import ship


def resized(cells: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th row and column, numbered anew: nearest-neighbour downsampling."""
    kept = cells.where(f"r % {factor} = 0 and c % {factor} = 0")
    return kept.withColumns({"r": (F.col("r") / factor).cast("long"), "c": (F.col("c") / factor).cast("long")})


def any_in_block(cells: DataFrame, flag: Column, factor: int) -> DataFrame:
    """Whether ``flag`` holds for any cell of each block."""
    block = lambda x: F.floor(F.col(x) / factor).alias(x)
    return cells.groupBy(block("r"), block("c")).agg(F.bool_or(flag).alias("hole"))


def enlarged(cells: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """The fine ``cells`` with the values of the coarse cells that they lie in."""
    fine = cells.select("r", "c", F.floor(F.col("r") / factor).alias("_r"), F.floor(F.col("c") / factor).alias("_c"))
    return fine.join(coarse.withColumnsRenamed({"r": "_r", "c": "_c"}), ["_r", "_c"]).drop("_r", "_c")


def dilated(mask: DataFrame, steps: int = 1) -> DataFrame:
    """Cells (r, c) at most ``steps`` moves from a cell of the mask: its dilation by the four neighbours."""
    move = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps))
    return mask.select("r", "c", F.explode(move).alias("m")).select((F.col("r") + F.col("m.a")).alias("r"), (F.col("c") + F.col("m.b")).alias("c")).distinct()


def mosaic(cells: DataFrame, order: Column, *bands: str) -> DataFrame:
    """One value per cell and band: that of the last source with data."""
    return cells.groupBy("r", "c").agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands))


def merged_where(original: DataFrame, filled: DataFrame, hole: str, band: str) -> DataFrame:
    """The filled value where there is a hole, the original elsewhere."""
    both = original.join(filled.select("r", "c", F.col(band).alias("_new")), ["r", "c"], "left")
    return both.withColumn(band, F.when(F.col(hole), F.col("_new")).otherwise(F.col(band))).drop("_new")


def labelled(mask: DataFrame) -> DataFrame:
    """Cells (r, c) with the label of their 4-connected component: its smallest r * 2**32 + c.

    Labels first run to the ends of the runs of each row, so that long components take few rounds; then runs that touch
    in neighbouring rows exchange the smaller one and follow it, until nothing changes.
    """
    w = Window.partitionBy("r").orderBy("c")
    start = F.when(F.coalesce(F.col("c") - F.lag("c").over(w), F.lit(2)) > 1, F.col("c"))
    runs = mask.withColumn("_s", start).withColumn("_s", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cut(runs.withColumn("node", F.col("r") * (1 << 32) + F.col("_s")).drop("_s"))
    below = cells.select((F.col("r") - 1).alias("r"), "c", F.col("node").alias("other"))
    edges = cells.join(below, ["r", "c"]).select("node", "other").distinct()
    edges = cut(edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = cut(cells.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("new"), "label")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        new = cut(new.join(jump, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return cells.join(labels, "node").drop("node")


def polygonized(cells: DataFrame, label: str = "label") -> DataFrame:
    """The outline of each component: (label, edges), the unit edges between it and what is not it, as an array."""
    sides = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for v, n in zip(s, ("dr", "dc", "x1", "y1", "x2", "y2"))))
            for s in ((-1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0), (0, 1, 1, 0, 1, 1))
        )
    )
    own = cells.select("r", "c", label)
    offered = own.select("r", "c", label, F.explode(sides).alias("s"))
    around = offered.select((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), label, F.col("r").alias("r0"), F.col("c").alias("c0"), "s")
    outer = around.join(own, ["r", "c", label], "left_anti")
    at = lambda base, name: (F.col(base) + F.col(f"s.{name}")).alias(name)
    edges = outer.select(label, at("c0", "x1"), at("r0", "y1"), at("c0", "x2"), at("r0", "y2"))
    return edges.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("edges"))


def component_boxes(cells: DataFrame, margin: int, raster: DataFrame, label: str = "label") -> DataFrame:
    """The bounding box of each component, grown by a margin and cut to the raster (r, c), with its number of cells."""
    boxes = cells.groupBy(label).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("cells"))
    ends = raster.agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    return boxes.crossJoin(F.broadcast(ends)).select(
        label,
        F.greatest(F.col("r0") - margin, F.lit(0)).alias("r0"),
        F.least(F.col("r1") + margin, "last_r").alias("r1"),
        F.greatest(F.col("c0") - margin, F.lit(0)).alias("c0"),
        F.least(F.col("c1") + margin, "last_c").alias("c1"),
        "cells",
    )


def _offsets(reach: int) -> Column:
    """(dr, dc, d2) of all cells at most ``reach`` away."""
    near = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach]
    return F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(a * a + b * b).alias("d2")) for a, b in near))


def filled_idw(cells: DataFrame, band: str, reach: int) -> DataFrame:
    """No-data cells get the mean of the cells around them, weighted by the inverse of the squared distance.

    Only cells with data near a hole offer their values; holes without data in reach stay empty.
    """
    holes = cells.where(F.col(band).isNull()).select("r", "c")
    values = cells.where(F.col(band).isNotNull()).select("r", "c", F.col(band).alias("v"))
    asked = holes.select("r", "c", F.explode(_offsets(reach)).alias("o"))
    asked = asked.select(F.col("r").alias("hr"), F.col("c").alias("hc"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "o.d2")
    near = asked.join(values, ["r", "c"]).groupBy("hr", "hc").agg((F.sum(F.col("v") / F.col("d2")) / F.sum(F.lit(1.0) / F.col("d2"))).alias("_f"))
    out = cells.join(near.withColumnsRenamed({"hr": "r", "hc": "c"}), ["r", "c"], "left")
    return out.withColumn(band, F.coalesce(F.col(band).cast("double"), F.col("_f"))).drop("_f")


def gaussian(cells: DataFrame, band: str, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """A Gaussian blur over cells with data; weights are renormalised at the edges of the data."""
    weight = F.exp(-F.col("o.d2") / (2 * sigma * sigma))
    spread = cells.where(F.col(band).isNotNull()).select("r", "c", F.col(band).alias("v"), F.explode(_offsets(reach)).alias("o"))
    spread = spread.select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), weight.alias("w"), "v")
    return spread.groupBy("r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(band)).join(cells.select("r", "c"), ["r", "c"], "left_semi")


TILE = 256


def gaussian_tiles(cells: DataFrame, band: str, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """The same blur in numpy, tile by tile: a tile gets its own cells and a margin of its neighbours'."""
    ship(cells.sparkSession)
    edge = lambda x: F.explode(F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col(x) + d) / TILE))))
    dealt = cells.select("r", "c", F.col(band).cast("double").alias("v")).withColumn("tr", edge("r")).withColumn("tc", edge("c"))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    square = np.add.outer(np.arange(-reach, reach + 1) ** 2, np.arange(-reach, reach + 1) ** 2) <= reach * reach

    def blur(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0, n = rows["tr"].iloc[0] * TILE - reach, rows["tc"].iloc[0] * TILE - reach, TILE + 2 * reach
        grid, there = np.zeros((n, n)), np.zeros((n, n))
        r, c = (rows["r"] - r0).to_numpy(), (rows["c"] - c0).to_numpy()
        ok = rows["v"].notna().to_numpy()
        grid[r[ok], c[ok]], there[r[ok], c[ok]] = rows["v"].to_numpy()[ok], 1
        total, weight = np.zeros((TILE, TILE)), np.zeros((TILE, TILE))
        for a in range(2 * reach + 1):
            for b in range(2 * reach + 1):
                if square[a, b]:
                    total += kernel[a] * kernel[b] * grid[a : a + TILE, b : b + TILE]
                    weight += kernel[a] * kernel[b] * there[a : a + TILE, b : b + TILE]
        own = (r >= reach) & (r < reach + TILE) & (c >= reach) & (c < reach + TILE)
        r, c = r[own], c[own]
        with np.errstate(invalid="ignore"):
            value = total[r - reach, c - reach] / weight[r - reach, c - reach]
        return pd.DataFrame({"r": r + r0, "c": c + c0, "v": value})

    return dealt.groupBy("tr", "tc").applyInPandas(blur, "r long, c long, v double").withColumnRenamed("v", band)


def rasterized(boxes: DataFrame, size: float) -> DataFrame:
    """Cells (r, c) that any box touches, its boundary included."""
    rows = F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))
    columns = F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))
    return boxes.select("xmin", "xmax", F.explode(rows).alias("r")).select("r", F.explode(columns).alias("c")).distinct()


def tiled(cells: DataFrame, size: int) -> DataFrame:
    """``cells`` with the tile (tr, tc) that they lie in and their place (r, c) in it."""
    tile = {f"t{x}": F.floor(F.col(x) / size) for x in "rc"}
    return cells.withColumns(tile).withColumns({x: F.pmod(F.col(x), F.lit(size)) for x in "rc"})


def translated(cells: DataFrame, band: str, low: float, high: float, nodata: int = 0) -> DataFrame:
    """A band scaled from [low, high] to whole numbers from 0 to 255, cut off at both ends; no data is ``nodata``."""
    scaled = F.floor((F.col(band) - low) * 255.0 / (high - low) + 0.5)
    return cells.withColumn(band, F.coalesce(F.greatest(F.lit(0), F.least(F.lit(255), scaled)), F.lit(nodata)).cast("int"))


def mosaic_index(cells: DataFrame, source: str) -> DataFrame:
    """(source, r0, c0, rows, columns, cells): where in a mosaic each source lies, as a virtual raster lists it."""
    ends = cells.groupBy(source).agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("cells"))
    return ends.select(source, "r0", "c0", (F.col("r1") - F.col("r0") + 1).alias("rows"), (F.col("c1") - F.col("c0") + 1).alias("columns"), "cells")


def footprint(rows: DataFrame) -> DataFrame:
    """The corner coordinates of rasters (x0, y0, px, width, height); an error where the transform isn't usable."""
    bad = (F.col("px") <= 0) | F.col("px").isNull()
    return rows.select(
        "*",
        F.when(~bad, F.col("x0") + F.col("width") * F.col("px")).alias("x1"),
        F.when(~bad, F.col("y0") - F.col("height") * F.col("px")).alias("y1"),
        F.when(bad, "bad transform").alias("error"),
    )

