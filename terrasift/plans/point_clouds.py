"""Queries over the point cloud: filters, projections, sampling, gridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions.geometry import cell, in_box, rounded
from terrasift.operators import points as P
from terrasift.operators.catalog import running_total
from terrasift.plans.fixtures import view
from terrasift.plans.registry import query

ROUND = "floor(({}) * 1e6 + 0.5) / 1e6"


def pts(spark, sf):
    return view(spark, sf, "v_points")


@query("select file, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from v_points group by file")
def scan_extent(spark, sf):
    return P.extent(pts(spark, sf), "file")


@query("select min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from v_points")
def agg_bbox_global(spark, sf):
    return P.extent(pts(spark, sf))


@query("select pt_key, classification from v_points where classification = 2")
def flt_class_eq(spark, sf):
    return P.of_class(pts(spark, sf), 2).select("pt_key", "classification")


@query("select pt_key, classification from v_points where classification <> 2")
def flt_class_ne(spark, sf):
    return P.of_class(pts(spark, sf), 2, keep=False).select("pt_key", "classification")


@query("select pt_key, red, green, blue from v_points where red <> 0 and green <> 0 and blue <> 0")
def flt_rgb_all(spark, sf):
    return P.colored(pts(spark, sf)).select("pt_key", "red", "green", "blue")


@query("select pt_key, red, green, blue from v_points where red <> 0 or green <> 0 or blue <> 0")
def flt_rgb_any(spark, sf):
    return pts(spark, sf).where("red <> 0 or green <> 0 or blue <> 0").select("pt_key", "red", "green", "blue")


@query("select pt_key, x, y from v_points where x between 20 and 40 and y between 10 and 30")
def flt_bbox(spark, sf):
    return pts(spark, sf).where(in_box("x", "y", F.lit(20.0), F.lit(10.0), F.lit(40.0), F.lit(30.0))).select("pt_key", "x", "y")


@query("""
select pt_key, case when classification = 5 and exists (
  select 1 from v_boxes b where p.x between b.xmin - 4 and b.xmin + 4 and p.y between b.ymin - 4 and b.ymin + 4) then 11 else classification end as classification
from v_points p""")
def flt_square_around(spark, sf):
    sites = view(spark, sf, "v_boxes").select(F.col("xmin").alias("sx"), F.col("ymin").alias("sy"))
    return P.reclass_near(pts(spark, sf), sites).select("pt_key", "classification")


@query("select pt_key, z from v_points where z <> 5.0")
def flt_sentinel(spark, sf):
    return pts(spark, sf).where(F.col("z") != 5.0).select("pt_key", "z")


@query("select pt_key, 2 as classification from v_points where classification = 1")
def proj_relabel_class(spark, sf):
    return P.of_class(pts(spark, sf), 1).select("pt_key", F.when(F.col("classification") == 1, 2).alias("classification"))


@query("select pt_key, cast(least(greatest(red * 30000, 0), 65535) as integer) as red from v_points")
def proj_clamp_cast(spark, sf):
    return pts(spark, sf).select("pt_key", F.least(F.greatest(F.col("red") * 30000, F.lit(0)), F.lit(65535)).cast("int").alias("red"))


@query("select pt_key, x, y, 0 as intensity, 0 as user_data from v_points")
def proj_zero_fields(spark, sf):
    rows = pts(spark, sf).withColumn("intensity", F.col("red")).withColumn("user_data", F.col("green"))
    return P.zero_fields(rows).select("pt_key", "x", "y", "intensity", "user_data")


def _grid(name, agg, sql):
    @query(
        f"select cast(floor(x) as bigint) as ix, cast(floor(y) as bigint) as iy, {ROUND.format(sql)} as z from v_points where classification = 2 group by all",
        name=f"agg_grid_{name}",
    )
    def run(spark, sf):
        ground = P.of_class(pts(spark, sf), P.GROUND)
        return P.grid(ground, 1.0, agg("z").alias("z")).select("ix", "iy", rounded("z").alias("z"))

    return run


agg_grid_min = _grid("min", F.min, "min(z)")
agg_grid_max = _grid("max", F.max, "max(z)")
agg_grid_mean = _grid("mean", F.avg, "avg(z)")

HISTOGRAM = """
with b as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from v_points), h as (
  select cast(least(floor(x - x0), greatest(ceil(x1 - x0) - 1, 0)) as bigint) as ix, cast(least(floor(y - y0), greatest(ceil(y1 - y0) - 1, 0)) as bigint) as iy, count(*) as n
  from v_points, b group by all)
"""


def _cells(spark, sf):
    p = pts(spark, sf)
    return P.histogram(p, P.extent(p))


@query(HISTOGRAM + "select ix, iy, n from h")
def agg_grid_count(spark, sf):
    return _cells(spark, sf)


@query(HISTOGRAM + "select ix, iy, n, n > 0 and n < 3 as low from h")
def agg_binary_threshold(spark, sf):
    return P.low_density(_cells(spark, sf), 3)


@query(HISTOGRAM + """, s as (select min(ix) a, max(ix) b, min(iy) c, max(iy) d from h), x as (select unnest(generate_series(a, b)) as ix, c, d from s),
 g as (select ix, unnest(generate_series(c, d)) as iy from x)
select g.ix, g.iy, coalesce(n, 0) as n, coalesce(n, 0) < 3 as low from g left join h on g.ix = h.ix and g.iy = h.iy""")
def agg_binary_threshold_dense(spark, sf):
    return P.low_density(_cells(spark, sf), 3, include_empty=True)


@query("select count(*) as cells, cast(count(*) as double) * 0.25 as area_m2, cast(count(*) as double) * 0.25 / 10000 as area_ha from (select distinct floor(x / 0.5), floor(y / 0.5) from v_points)")
def agg_coverage_area(spark, sf):
    cells = P.grid(pts(spark, sf), 0.5, F.count(F.lit(1)).alias("n"))
    n = F.count(F.lit(1))
    return cells.agg(n.alias("cells"), (n.cast("double") * 0.25).alias("area_m2"), (n.cast("double") * 0.25 / 10000).alias("area_ha"))


@query(f"select file, {ROUND.format('avg(z)')} as mean_z, contains(file, 'F') as flagged from v_points group by file")
def agg_mean_z(spark, sf):
    return pts(spark, sf).groupBy("file").agg(rounded(F.avg("z")).alias("mean_z")).withColumn("flagged", F.contains("file", F.lit("F")))


@query("select pt_key from (select pt_key, row_number() over (order by md5('s:' || pt_key), pt_key) as n, count(*) over () as c from v_points) where n <= floor(c * 0.3)")
def smp_fraction(spark, sf):
    return P.sample_fraction(pts(spark, sf), 0.3).select("pt_key")


CAP = """
with r as (select *, row_number() over (partition by classification = 2, floor(x / 4), floor(y / 4) order by md5('t:' || pt_key), pt_key) as n from v_points)
"""


@query(CAP + "select pt_key from r where n <= 5")
def smp_grid_cap(spark, sf):
    marked = pts(spark, sf).withColumn("is_ground", F.col("classification") == 2)
    return P.cap_per_tile(marked, 5, 4.0, ("is_ground",)).select("pt_key")


@query("""
with r as (select *, row_number() over (partition by file order by md5('c:' || pt_key), pt_key) as n, count(*) over (partition by file) as c from v_points)
select pt_key, file from r where c <= 4000 or n <= 1000""")
def smp_cap_threshold(spark, sf):
    return P.cap_above(pts(spark, sf), 4000, 1000, "file").select("pt_key", "file")


@query("""
with r as (select *, row_number() over (partition by classification = 2, floor(x), floor(y) order by md5('t:' || pt_key), pt_key) as n from v_points)
select pt_key, x, y, z from r where n <= 3 and red <> 0 and green <> 0 and blue <> 0""")
def cq_subsample_clean(spark, sf):
    return P.thin_clean(pts(spark, sf), 3).select("pt_key", "x", "y", "z")


FILL = """
with g as (select cast(floor(x) as bigint) as ix, cast(floor(y) as bigint) as iy, avg(z) as z from v_points where classification = 2 group by all),
 s as (select min(ix) a, max(ix) b, min(iy) c, max(iy) d from g),
 o as (select g.ix + dx as tx, g.iy + dy as ty, ix, iy, z, dx * dx + dy * dy as d2 from g,
  (select unnest([-2, -1, 0, 1, 2]) as dx), (select unnest([-2, -1, 0, 1, 2]) as dy), s
  where dx * dx + dy * dy <= 4 and g.ix + dx between s.a and s.b and g.iy + dy between s.c and s.d),
 r as (select *, row_number() over (partition by tx, ty order by d2, iy, ix) as n from o)
"""


@query(FILL + f"select tx as ix, ty as iy, {ROUND.format('z')} as z, d2 > 0 as filled from r where n = 1")
def ras_fill_nearest(spark, sf):
    ground = P.grid(P.of_class(pts(spark, sf), P.GROUND), 1.0, F.avg("z").alias("z"))
    return P.fill_nearest(ground, "z", 2).select("ix", "iy", rounded("z").alias("z"), "filled")


@query(FILL + f"select tx as ix, ty as iy, cast({ROUND.format('z')} as float) as z from r where n = 1")
def cq_dem(spark, sf):
    ground = P.grid(P.of_class(pts(spark, sf), P.GROUND), 1.0, F.avg("z").alias("z"))
    return P.fill_nearest(ground, "z", 2).select("ix", "iy", rounded("z").cast("float").alias("z"))


@query("select distinct file from v_points order by file")
def distinct_ordered(spark, sf):
    return pts(spark, sf).select("file").distinct().orderBy("file")


@query("select file, pt_key from v_points union all select file, pt_key from v_points where classification = 2")
def union_all(spark, sf):
    p = pts(spark, sf).select("file", "pt_key", "classification")
    return p.unionByName(P.of_class(p, 2), allowMissingColumns=True).drop("classification")


@query("select cast(floor(x / 10) as bigint) as tx, cast(floor(y / 10) as bigint) as ty, count(*) as n, count(distinct file) as files from v_points group by all")
def merge_by_tile(spark, sf):
    keyed = pts(spark, sf).withColumn("tx", cell("x", 10)).withColumn("ty", cell("y", 10))
    return keyed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@query("""
with a as (select poly_id, abs(xmax - xmin) * abs(ymax - ymin) as area from v_boxes)
select poly_id, area, sum(cast(area as bigint)) over (order by poly_id rows unbounded preceding) / sum(cast(area as bigint)) over () as cdf from a""")
def win_cumsum_cdf(spark, sf):
    rows = view(spark, sf, "v_boxes").select("poly_id", ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"))
    rows = rows.withColumn("whole", F.col("area").cast("long"))
    total = rows.agg(F.sum("whole").alias("total"))  # one row
    return running_total(rows, "whole", "poly_id").join(F.broadcast(total)).select("poly_id", "area", (F.col("running") / F.col("total")).alias("cdf"))
