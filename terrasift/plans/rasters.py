"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.operators import overlay as O
from terrasift.operators import points as P
from terrasift.operators import raster as R
from terrasift.operators import spatial as S
from terrasift.plans.fixtures import view
from terrasift.plans.registry import query


def ras(spark, sf):
    return view(spark, sf, "v_raster")


@query("select poly_id, xmin as x0, ymax as y0, xmin + 10 * (0.25 + poly_id % 3) as x1, ymax - 20 * (0.25 + poly_id % 3) as y1 from v_boxes")
def raster_extent(spark, sf):
    rows = view(spark, sf, "v_boxes").select("poly_id", F.col("xmin").alias("x0"), F.col("ymax").alias("y0"), (F.lit(0.25) + F.col("poly_id") % 3).alias("px"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    return R.footprint(rows).select("poly_id", "x0", "y0", "x1", "y1")


@query("""select poly_id, case when poly_id % 4 > 0 then xmin + 10 * (poly_id % 4) end as x1, case when poly_id % 4 > 0 then null else 'bad transform' end as error from v_boxes""")
def ras_footprint(spark, sf):
    rows = view(spark, sf, "v_boxes").select("poly_id", F.col("xmin").alias("x0"), F.col("ymax").alias("y0"), (F.col("poly_id") % 4).cast("double").alias("px"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    return R.footprint(rows).select("poly_id", "x1", "error")


@query("select src, count(*) filter (where band1 is not null and band1 % 4 <> 0) as valid, cast(count(*) filter (where band1 is not null and band1 % 4 <> 0) as double) * 0.0625 as area from v_raster group by src")
def agg_valid_area(spark, sf):
    n = F.count_if(F.col("band1").isNotNull() & (F.col("band1") % 4 != 0))
    return ras(spark, sf).groupBy("src").agg(n.alias("valid"), (n.cast("double") * 0.0625).alias("area"))


@query("""
with s as (select src, count(*) filter (where band1 % 2 = 0) as zeros, count(*) filter (where band1 % 2 = 1) as ones from v_raster where c between 5 and 100 group by src)
select src, zeros, ones, case when zeros + ones > 0 then floor(ones * 10000 / (zeros + ones)) / 100 end as percent,
 case when zeros + ones = 0 then 'NO DATA' when ones * 100 >= 95 * (zeros + ones) then 'ok' else 'TOO EMPTY' end as flag from s""")
def agg_pixel_stats(spark, sf):
    rows = ras(spark, sf).where("c between 5 and 100").groupBy("src").agg(F.count_if(F.col("band1") % 2 == 0).alias("zeros"), F.count_if(F.col("band1") % 2 == 1).alias("ones"))
    total = F.col("zeros") + F.col("ones")
    percent = F.when(total > 0, F.floor(F.col("ones") * 10000 / total) / 100)
    flag = F.when(total == 0, "NO DATA").when(F.col("ones") * 100 >= 95 * total, "ok").otherwise("TOO EMPTY")
    return rows.withColumns({"percent": percent, "flag": flag})


@query("""select src, count(*) filter (where band1 = 0) as zero, count(*) filter (where band1 > 0 and band1 < 50) as low, count(*) filter (where band1 >= 50) as high,
 floor(count(*) filter (where band1 >= 50) * 10000.0 / count(band1)) / 100 as high_pct from v_raster group by src""")
def agg_bucket_pct(spark, sf):
    high = F.count_if(F.col("band1") >= 50)
    return ras(spark, sf).groupBy("src").agg(
        F.count_if(F.col("band1") == 0).alias("zero"), F.count_if((F.col("band1") > 0) & (F.col("band1") < 50)).alias("low"), high.alias("high"),
        (F.floor(high * 10000.0 / F.count("band1")) / 100).alias("high_pct"),
    )


MOSAIC = "select r // 2 as r, c, src, band1, band2 from v_raster"


@query(f"with m as ({MOSAIC}) select r, c, coalesce(arg_max(band1, src) filter (where band1 is not null), -1) as band1, arg_max(band2, src) as band2 from (select r, c, src, max(band1) as band1, max(band2) as band2 from m group by r, c, src) group by r, c")
def raster_mosaic(spark, sf):
    cells = ras(spark, sf).select(F.floor(F.col("r") / 2).alias("r"), "c", "src", "band1", "band2")
    one = cells.groupBy("r", "c", "src").agg(F.max("band1").alias("band1"), F.max("band2").alias("band2"))
    return R.mosaic(one, F.col("src"), "band1", "band2").select("r", "c", F.coalesce("band1", F.lit(-1)).alias("band1"), "band2")


@query("""select a.r, a.c from v_raster a join v_boxes b on a.c + 0.5 between b.xmin and b.xmax and a.r + 0.5 between b.ymin and b.ymax where a.band1 is not null group by all""")
def raster_mask_and(spark, sf):
    cells = ras(spark, sf).where("band1 is not null").select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return S.box_join(cells, view(spark, sf, "v_boxes")).select("r", "c").distinct()


@query("""with p as (select r, c, c + 0.5 as x, r + 0.5 as y, band2 from v_raster),
 q as (select p.r, p.c, p.band2, e.poly_id, sum(case when (e.y1 > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 then 1 else 0 end) as n,
 sum(case when (e.x2 - e.x1) * (p.y - e.y1) = (e.y2 - e.y1) * (p.x - e.x1) and p.x between least(e.x1, e.x2) and greatest(e.x1, e.x2) and p.y between least(e.y1, e.y2) and greatest(e.y1, e.y2) then 1 else 0 end) as b
 from p join v_polys e on p.x between e.xmin and e.xmax and p.y between e.ymin and e.ymax group by all)
select distinct r, c, band2 from q where n % 2 = 1 or b > 0""")
def ras_mask(spark, sf):
    cells = ras(spark, sf).select("r", "c", "band2", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return S.point_in_polygon(cells, S.polygons(view(spark, sf, "v_polys")), boundary=True).select("r", "c", "band2").distinct()


@query("select r // 10 as r, c // 10 as c, coalesce(band1, -1) as band1 from v_raster where r % 10 = 0 and c % 10 = 0")
def ras_downsample(spark, sf):
    return R.resized(ras(spark, sf), 10).select("r", "c", F.coalesce("band1", F.lit(-1)).alias("band1"))


@query("select r // 4 as r, c // 4 as c, band2 from v_raster where r % 4 = 0 and c % 4 = 0")
def ras_overview(spark, sf):
    return R.resized(ras(spark, sf), 4).select("r", "c", "band2")


@query("select r // 10 as r, c // 10 as c, bool_or(band1 is null) as hole from v_raster group by all")
def ras_mask_any(spark, sf):
    return R.any_in_block(ras(spark, sf), F.col("band1").isNull(), 10)


@query("with k as (select r // 10 as rr, c // 10 as cc, bool_or(band1 is null) as hole from v_raster group by all) select r, c, hole from v_raster join k on rr = r // 10 and cc = c // 10")
def ras_upsample(spark, sf):
    cells = ras(spark, sf)
    return R.enlarged(cells, R.any_in_block(cells, F.col("band1").isNull(), 10), 10)


HOLES = "select r, c from v_raster where band2 > 400"


@query(f"with h as ({HOLES}), m as (select unnest([-2,-1,-1,-1,0,0,0,0,0,1,1,1,2]) as dr, unnest([0,-1,0,1,-2,-1,0,1,2,-1,0,1,0]) as dc) select distinct r + dr as r, c + dc as c from h, m")
def ras_dilate(spark, sf):
    return R.dilated(ras(spark, sf).where("band2 > 400").select("r", "c"), 2)


@query("select r, c, case when band1 is null then band2 else band1 end as band1 from v_raster")
def ras_conditional_merge(spark, sf):
    cells = ras(spark, sf).withColumn("hole", F.col("band1").isNull())
    return R.merged_where(cells, cells.select("r", "c", F.col("band2").alias("band1")), "hole", "band1").select("r", "c", "band1")


@query("select r, c, 2 as band, band2 as value from v_raster where c < 60 union all select r, c, 1 as band, band1 as value from v_raster where band1 is not null and c >= 60")
def ras_band_select(spark, sf):
    cells = ras(spark, sf)
    long_ = cells.select("r", "c", F.expr("stack(2, 1, cast(band1 as bigint), 2, band2) as (band, value)"))
    return long_.where("(band = 2 and c < 60) or (band = 1 and c >= 60 and value is not null)")


COMPONENTS = """
with recursive h as (select r, c from v_raster where band2 > 300), e as (select a.r * 4294967296 + a.c as u, b.r * 4294967296 + b.c as v from h a join h b on abs(a.r - b.r) + abs(a.c - b.c) = 1),
 w as (select r * 4294967296 + c as u, r * 4294967296 + c as l from h union select e.v, w.l from w join e on e.u = w.u)
select u // 4294967296 as r, u % 4294967296 as c, min(l) as first_cell from w group by u"""


def holes(spark, sf):
    return ras(spark, sf).where("band2 > 300").select("r", "c")


def first_cell():
    """The smallest cell of a component; labels name the start of its first run, which is that cell."""
    return F.col("label").alias("first_cell")


@query(COMPONENTS)
def ras_label(spark, sf):
    return R.labelled(holes(spark, sf)).select("r", "c", first_cell())


@query(f"with k as ({COMPONENTS.strip()}) select first_cell, greatest(min(r) - 3, 0) as r0, least(max(r) + 3, (select max(r) from v_raster)) as r1, greatest(min(c) - 3, 0) as c0, least(max(c) + 3, (select max(c) from v_raster)) as c1, count(*) as cells from k group by first_cell")
def ras_bbox_expand(spark, sf):
    return R.component_boxes(R.labelled(holes(spark, sf)), 3, ras(spark, sf)).withColumnRenamed("label", "first_cell")


@query(f"""with k as ({COMPONENTS.strip()}), a as (select first_cell, count(*) as cells from k group by first_cell), o as (select *, row_number() over (order by cells desc, first_cell) as n from a)
select first_cell, cells from o where n > 1 and cells >= 2""")
def flt_area_lt(spark, sf):
    areas = R.labelled(holes(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    most = areas.agg(F.max(F.struct("cells", (-F.col("label")).alias("label"))).alias("m")).select((-F.col("m.label")).alias("label"))
    return areas.join(F.broadcast(most), "label", "left_anti").where("cells >= 2").select(first_cell(), "cells")


@query(f"""with k as ({COMPONENTS.strip()}), a as (select first_cell, count(*) as cells from k group by first_cell)
select cells, min(first_cell) as first_cell from a group by cells having count(*) = 1""")
def flt_mode_value(spark, sf):
    areas = R.labelled(holes(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    return areas.groupBy("cells").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_cell")).where("n = 1").drop("n")


@query("""with recursive x as (select cast(floor(x) as bigint) as c, cast(floor(y) as bigint) as r, count(*) as n from v_points group by all),
 h as (select r, c from x where n > 0 and n < 8), e as (select a.r * 4294967296 + a.c as u, b.r * 4294967296 + b.c as v from h a join h b on abs(a.r - b.r) + abs(a.c - b.c) = 1),
 w as (select r * 4294967296 + c as u, r * 4294967296 + c as l from h union select e.v, w.l from w join e on e.u = w.u),
 k as (select u, min(l) as l from w group by u), a as (select l as first_cell, count(*) as cells from k group by l), o as (select *, row_number() over (order by cells desc, first_cell) as n from a)
select first_cell, cells, cells * 100 as fill_points from o where n > 1 and cells >= 2""")
def cq_low_density_zones(spark, sf):
    cells = P.grid(view(spark, sf, "v_points"), 1.0, F.count(F.lit(1)).alias("n"))
    low = P.low_density(cells, 8).where("low").select(F.col("iy").alias("r"), F.col("ix").alias("c"))
    areas = R.labelled(low).groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    most = areas.agg(F.max(F.struct("cells", (-F.col("label")).alias("label"))).alias("m")).select((-F.col("m.label")).alias("label"))
    kept = areas.join(F.broadcast(most), "label", "left_anti").where("cells >= 2")
    return kept.select(first_cell(), "cells", (F.col("cells") * 100).alias("fill_points"))


def low_density_polygons(cells, least: int = 100, grown: float = 4.0, hole: float = 100.0, tolerance: float = 5.0):
    """Outlines of the areas of cells (label, r, c): the largest area and those of fewer than ``least`` cells go; the others
    are grown, their holes up to ``hole`` closed, simplified and turned counter-clockwise; of the areas, the commonest goes
    if it occurs more than once."""
    areas = cells.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    most = areas.agg(F.max(F.struct("cells", (-F.col("label")).alias("label"))).alias("m")).select((-F.col("m.label")).alias("label"))
    kept = areas.join(F.broadcast(most), "label", "left_anti").where(F.col("cells") >= least).select("label")
    found = O.buffers(O.cell_edges(cells.join(kept, "label", "left_semi"), "label"), "label", grown)
    found = O.simplified_rings(found.where((F.col("area") > 0) | (F.col("area") < -hole)), tolerance)
    shaped = O.counter_clockwise(found.withColumn("hole", F.col("area") < 0)).withColumn("shown", G.rounded("area", 4))
    repeated = shaped.groupBy("shown").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = repeated.agg(F.max_by("shown", F.struct("n", (-F.col("shown")).alias("s"))).alias("shown")).where("shown is not null")
    return shaped.join(F.broadcast(common), "shown", "left_anti")  # one row


@query()
def cq_low_density_polygons(spark, sf):
    cells = P.grid(view(spark, sf, "v_points"), 1.0, F.count(F.lit(1)).alias("n"))
    low = P.low_density(cells, 8).where("low").select(F.col("iy").alias("r"), F.col("ix").alias("c"))
    found = low_density_polygons(R.labelled(low))
    return found.select(F.col("label").alias("first_cell"), "hole", F.size("ring").alias("corners"), F.col("shown").alias("area"))


@query(f"""with k as ({COMPONENTS.strip()}) select first_cell, count(*) as area from k group by first_cell""")
def ras_polygonize_rings(spark, sf):
    """Outlines and holes as rings; their signed areas add up to the cells."""
    found = O.rings(O.cell_edges(R.labelled(holes(spark, sf)), "label"), "label")
    return found.groupBy("label").agg(F.sum("area").cast("long").alias("area")).select(first_cell(), "area")


@query(f"""with k as ({COMPONENTS.strip()}), a as (select first_cell, r, c from k), m as (select unnest([-1,1,0,0]) as dr, unnest([0,0,-1,1]) as dc)
select first_cell, count(*) as edges from a, m where not exists (select 1 from a b where b.first_cell = a.first_cell and b.r = a.r + dr and b.c = a.c + dc) group by first_cell""")
def ras_polygonize(spark, sf):
    return R.polygonized(R.labelled(holes(spark, sf))).select(first_cell(), F.size("edges").cast("long").alias("edges"))


@query("""with b as (select *, cast(floor(ymin / 2) as bigint) as a, cast(floor(ymax / 2) as bigint) as z, cast(floor(xmin / 2) as bigint) as f, cast(floor(xmax / 2) as bigint) as g from v_boxes),
 r as (select unnest(range(a, z + 1)) as r, f, g from b) select distinct r, c from (select r, unnest(range(f, g + 1)) as c from r)""")
def ras_rasterize(spark, sf):
    return R.rasterized(view(spark, sf, "v_boxes"), 2.0)


@query("""with h as (select r, c from v_raster where band1 is null), v as (select r, c, band1 from v_raster where band1 is not null),
 n as (select h.r, h.c, sum(cast(v.band1 as double) / ((h.r - v.r) * (h.r - v.r) + (h.c - v.c) * (h.c - v.c))) / sum(1.0 / ((h.r - v.r) * (h.r - v.r) + (h.c - v.c) * (h.c - v.c))) as f
  from h join v on abs(h.r - v.r) <= 3 and abs(h.c - v.c) <= 3 and (h.r - v.r) * (h.r - v.r) + (h.c - v.c) * (h.c - v.c) <= 9 group by all)
select x.r, x.c, floor(coalesce(cast(band1 as double), f) * 1e6 + 0.5) / 1e6 as band1 from v_raster x left join n on n.r = x.r and n.c = x.c""")
def ras_fillnodata(spark, sf):
    return R.filled_idw(ras(spark, sf), "band1", 3).select("r", "c", G.rounded("band1").alias("band1"))


@query("""with k as (select unnest(range(-2, 3)) as dr), o as (select dr, dc from k, (select unnest(range(-2, 3)) as dc) where dr * dr + dc * dc <= 4),
 s as (select v.r + dr as r, v.c + dc as c, band1 * exp(-(dr * dr + dc * dc) / 2.0) as a, exp(-(dr * dr + dc * dc) / 2.0) as w from v_raster v, o where band1 is not null)
select s.r, s.c, floor(sum(a) / sum(w) * 1e6 + 0.5) / 1e6 as band1 from s join v_raster v on v.r = s.r and v.c = s.c group by all""")
def ras_gaussian(spark, sf):
    blurred = R.gaussian_tiles(ras(spark, sf), "band1", 1.0, 2).where("not isnan(band1)")
    return blurred.select("r", "c", G.rounded("band1").alias("band1"))


@query("select (select max(r) from v_raster) - r as r, c, 10.0 + c * 0.5 as x, 300.0 - (r + 1) * 0.5 as y, band2 from v_raster")
def ras_flip(spark, sf):
    """Rows counted from the top, and the coordinates of each cell's corner."""
    rows = ras(spark, sf)
    last = F.broadcast(rows.agg(F.max("r").alias("last")))  # one row
    return rows.join(last).select(
        (F.col("last") - F.col("r")).alias("r"), "c", (F.lit(10.0) + F.col("c") * 0.5).alias("x"), (F.lit(300.0) - (F.col("r") + 1) * 0.5).alias("y"), "band2"
    )


@query("select distinct r, c from v_raster, v_boxes where (c between xmin and xmax and r between ymin and ymax) or (c between xmin + 20 and xmax + 20 and r between ymin and ymax)")
def agg_union_area(spark, sf):
    """Cells in the union of several layers: in one of them, whichever; the union itself is never built."""
    boxes = view(spark, sf, "v_boxes").select("poly_id", "xmin", "ymin", "xmax", "ymax")
    moved = boxes.withColumns({c: F.col(c) + 20 for c in ("xmin", "xmax")})
    cells = ras(spark, sf).select("r", "c", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return S.box_join(cells, boxes.union(moved)).select("r", "c").distinct()


@query("select r // 32 as tr, c // 32 as tc, count(*) as cells, max(r % 32) as last_r, max(c % 32) as last_c, count(band1) as filled from v_raster group by all")
def ras_tile(spark, sf):
    tiles = R.tiled(ras(spark, sf), 32)
    return tiles.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("cells"), F.max("r").alias("last_r"), F.max("c").alias("last_c"), F.count("band1").alias("filled"))


@query("select r, c, cast(coalesce(greatest(0, least(255, floor((band1 - 20) * 255.0 / 180 + 0.5))), 0) as integer) as band1 from v_raster")
def ras_translate(spark, sf):
    return R.translated(ras(spark, sf), "band1", 20.0, 200.0).select("r", "c", "band1")


@query("select src, min(r) as r0, min(c) as c0, max(r) - min(r) + 1 as rows, max(c) - min(c) + 1 as columns, count(*) as cells from v_raster group by src")
def ras_vrt(spark, sf):
    return R.mosaic_index(ras(spark, sf), "src")
