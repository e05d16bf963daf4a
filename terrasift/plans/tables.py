"""Queries over plain tables: projections, windows, relational joins, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.functions import geometry as G
from terrasift.operators import catalog as C
from terrasift.operators import trajectory as TR
from terrasift.plans.fixtures import view
from terrasift.plans.registry import query

R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
MICROS = "epoch_us(ts)"


def micros(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def traj(spark, sf):
    return view(spark, sf, "v_traj").withColumn("us", micros())


@query("select event_id, 0 as pitch, yaw from v_traj")
def proj_drop_reorder(spark, sf):
    rows = traj(spark, sf).withColumn("pitch", F.lit(0))
    return rows.drop("user_id", "ts", "us").select("event_id", "pitch", "yaw")


@query("select c_custkey, c_acctbal - 40.5 as height, 0 as pitch, c_name || '.jpg' as filename from customer")
def proj_constant(spark, sf):
    rows = view(spark, sf, "customer").withColumns({"height": F.col("c_acctbal") - F.lit(40.5), "pitch": F.lit(0), "filename": F.concat("c_name", F.lit(".jpg"))})
    return rows.select("c_custkey", F.col("height"), "pitch", "filename")


@query("""
with f as (select c_custkey, c_name, row_number() over (order by c_custkey) as n from customer), b as (select s_suppkey, s_acctbal, row_number() over (order by s_suppkey) as n from supplier)
select c_name, s_acctbal as height from f join b on f.n = b.n""")
def positional_join(spark, sf):
    front, rear = view(spark, sf, "customer"), view(spark, sf, "supplier")
    return C.positional_join(front, "c_custkey", rear, "s_suppkey").select("c_name", F.col("s_acctbal").alias("height"))


@query(f"select event_id, {R6.format('degrees(value / 100)')} as lat from events")
def proj_radians_to_degrees(spark, sf):
    return view(spark, sf, "events").select("event_id", G.rounded(F.degrees(F.col("value") / 100)).alias("lat"))


@query("""
select o.o_orderkey, case when o_orderstatus = 'F' then o_totalprice else c_acctbal end as height,
 case when o_orderstatus = 'F' then 'Completed' when o_orderstatus = 'P' then 'Skipped' end as status
from orders o left join customer c on o_custkey = c_custkey""")
def proj_conditional_update(spark, sf):
    rows = view(spark, sf, "orders").join(view(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    done = F.col("o_orderstatus") == "F"
    status = F.when(done, "Completed").when(F.col("o_orderstatus") == "P", "Skipped")
    return rows.select("o_orderkey", F.when(done, F.col("o_totalprice")).otherwise(F.col("c_acctbal")).alias("height"), status.alias("status"))


@query("select fid, floor(((max(x) + min(x)) / 2) * 100 + 0.5) / 100 as mid_x, floor(((max(y) + min(y)) / 2) * 100 + 0.5) / 100 as mid_y from v_vertices group by fid")
def proj_midrange(spark, sf):
    mid = lambda c: G.rounded((F.max(c) + F.min(c)) / 2, 2)
    return view(spark, sf, "v_vertices").groupBy("fid").agg(mid("x").alias("mid_x"), mid("y").alias("mid_y"))


@query("select poly_id, xmin as gt0, ymax - 0.04 as gt3, (xmax - xmin) / 100 as px from v_boxes")
def proj_geotransform_shift(spark, sf):
    return view(spark, sf, "v_boxes").select("poly_id", F.col("xmin").alias("gt0"), (F.col("ymax") - 0.04).alias("gt3"), ((F.col("xmax") - F.col("xmin")) / 100).alias("px"))


@query("""
with s as (select poly_id, 5000.0 + poly_id * 7 as w, 1000.0 + poly_id * 31 as h from v_boxes), k as (select *, least(least(2000 / w, 2000 / h), 1.0) as scale from s)
select poly_id, scale, cast(greatest(1, floor(w * scale)) as bigint) as width, cast(greatest(1, floor(h * scale)) as bigint) as height, 0.25 / scale as px from k""")
def proj_preview_scale(spark, sf):
    rows = view(spark, sf, "v_boxes").select("poly_id", (5000.0 + F.col("poly_id") * 7).alias("w"), (1000.0 + F.col("poly_id") * 31).alias("h"))
    rows = rows.withColumn("scale", F.least(F.lit(2000) / F.col("w"), F.lit(2000) / F.col("h"), F.lit(1.0)))
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.col("scale"))).cast("long")
    return rows.select("poly_id", "scale", side("w").alias("width"), side("h").alias("height"), (F.lit(0.25) / F.col("scale")).alias("px"))


@query("select s_suppkey, row_number() over (order by s_name, s_suppkey) as id from supplier")
def proj_stable_id(spark, sf):
    rows = C.numbered(view(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", "s_suppkey")
    return rows.select("s_suppkey", (F.col("_n") + 1).alias("id"))


@query("""
select page_id, split_part(url, '/', -1) as leaf, split_part(split_part(url, '/', 3), '.', 1) as stem, case when contains(url, '.') then split_part(url, '.', -1) end as ext, length(url) as n from pages""")
def proj_file_name_parts(spark, sf):
    url = F.col("url")
    return view(spark, sf, "pages").select(
        "page_id",
        F.split_part(url, F.lit("/"), F.lit(-1)).alias("leaf"),
        F.split_part(F.split_part(url, F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("stem"),
        F.when(F.contains(url, F.lit(".")), F.split_part(url, F.lit("."), F.lit(-1))).alias("ext"),
        F.length(url).cast("long").alias("n"),
    )


@query("select event_id, ts, yaw from v_traj where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-05 12:00:00'")
def flt_time_range(spark, sf):
    rows = view(spark, sf, "v_traj")
    return rows.where(F.col("ts").between(F.expr("timestamp_ntz'2024-01-02 00:00:00'"), F.expr("timestamp_ntz'2024-01-05 12:00:00'"))).select("event_id", "ts", "yaw")


HEADING = """
with s as (select user_id, first(yaw order by ts, event_id) as y0 from v_traj group by user_id), o as (select *, case when y0 > 0 then y0 - 180 else y0 + 180 end as y1 from s)
"""


@query(HEADING + "select event_id, t.user_id, yaw from v_traj t join o using (user_id) where yaw between y0 - 6 and y0 + 6 or yaw between y1 - 6 and y1 + 6")
def flt_heading_band(spark, sf):
    return TR.heading_band(traj(spark, sf), "user_id", ["us", "event_id"], 6.0).select("event_id", "user_id", "yaw")


@query("select p_partkey, p_name, p_brand from part where not starts_with(p_name, 'a') and split_part(p_type, ' ', 1) <> 'STANDARD'")
def flt_regex_prefix(spark, sf):
    rows = view(spark, sf, "part").where(~F.col("p_name").rlike("^a") & (F.split_part("p_type", F.lit(" "), F.lit(1)) != "STANDARD"))
    return rows.select("p_partkey", "p_name", "p_brand")


@query("select o_orderkey, o_orderstatus from orders where o_orderpriority not in ('1-URGENT', '5-LOW') and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def flt_in_list(spark, sf):
    rows = view(spark, sf, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    good = view(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return rows.join(good, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("select id, kod from v_codes where kod in ('RD', 'RDS', 'RGS')")
def flt_code_allowed(spark, sf):
    return view(spark, sf, "v_codes").where(F.col("kod").isin("RD", "RDS", "RGS")).select("id", "kod")


@query("select p_partkey, p_name from part where lower(p_name) like '%e'")
def flt_suffix(spark, sf):
    return view(spark, sf, "part").where(F.endswith(F.lower("p_name"), F.lit("e"))).select("p_partkey", "p_name")


@query("select fid, count(*) as n from v_vertices group by fid having count(*) >= 2")
def flt_geom_null_empty(spark, sf):
    return view(spark, sf, "v_vertices").groupBy("fid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("select o.o_orderkey, c.c_name from orders o left join customer c on o.o_custkey = c.c_custkey and o.o_orderstatus = 'F'")
def join_left_equi(spark, sf):
    keyed = view(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")))
    return keyed.join(view(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), "k", "left").select("o_orderkey", "c_name")


@query("""
with a as (select o_orderstatus as s, case when o_orderpriority = '1-URGENT' then null else o_orderpriority end as p, count(*) as n from orders group by all),
 b as (select o_orderstatus as s, case when o_orderpriority = '1-URGENT' then null else o_orderpriority end as p, max(o_orderkey) as top from orders where o_orderstatus <> 'P' group by all)
select a.s as status, a.p as priority, n, coalesce(top, -1) as top from a left join b on a.s = b.s and a.p is not distinct from b.p""")
def join_left_nullsafe(spark, sf):
    rows = view(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")))
    a = rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("p").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    b = rows.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("s"), "p").agg(F.max("o_orderkey").alias("top"))
    same = (F.col("status") == F.col("s")) & F.col("priority").eqNullSafe(F.col("p"))
    return a.join(b, same, "left").select("status", "priority", "n", F.coalesce("top", F.lit(-1)).alias("top"))


@query("""
with e as (select numer, unnest(string_split(sasiedzi, ',')) as part, unnest(range(len(string_split(sasiedzi, ',')))) as pos from v_edges)
select e.numer, string_agg(c.c_name, ',' order by pos, c.c_custkey) as names from e join customer c on try_cast(part as bigint) = c.c_custkey group by e.numer""")
def join_list_membership(spark, sf):
    names = view(spark, sf, "customer").select(F.col("c_custkey").alias("element"), "c_name")
    return C.list_lookup(view(spark, sf, "v_edges"), "numer", "sasiedzi", names, "c_name").withColumnRenamed("found", "names")


@query("select c.c_custkey, n.n_nationkey from customer c join nation n on contains(c.c_name, '00' || n.n_nationkey)")
def join_substring(spark, sf):
    """Names that contain a tile's; one tile's may be the beginning of another's."""
    tiles = view(spark, sf, "nation").withColumn("tile", F.concat(F.lit("00"), F.col("n_nationkey").cast("string")))
    return C.contains_join(view(spark, sf, "customer"), "c_name", tiles, "tile").select("c_custkey", "n_nationkey")


@query("select a.s_suppkey, b.c_custkey from supplier a join customer b on split_part(a.s_name, '#', 2) = split_part(b.c_name, '#', 2)")
def join_name_equal(spark, sf):
    a = view(spark, sf, "supplier").withColumn("stem", F.split_part("s_name", F.lit("#"), F.lit(2)))
    b = view(spark, sf, "customer").withColumn("stem", F.split_part("c_name", F.lit("#"), F.lit(2)))
    return a.join(b, "stem").select("s_suppkey", "c_custkey")


@query("select c_custkey, coalesce(case when n_nationkey < 12 then n_name end, 'nation-' || c_nationkey) as name from customer left join nation on c_nationkey = n_nationkey")
def join_lookup_default(spark, sf):
    names = view(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    default = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
    return view(spark, sf, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", default).alias("name"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def join_anti_done(spark, sf):
    """What isn't done yet: customers without a finished urgent order."""
    done = view(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return view(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("select r_name || '/' || n_name as path from region cross join nation")
def join_cross(spark, sf):
    # folder names by sub-folder names: both sides are the few constants of a directory layout
    return view(spark, sf, "region").crossJoin(view(spark, sf, "nation")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))


SESSIONS = f"""
with g as (select *, {MICROS} as us from v_traj), d as (select *, us - lag(us) over (partition by user_id order by us, event_id) as gap from g),
 s as (select *, sum(case when gap > 3600000000 then 1 else 0 end) over (partition by user_id order by us, event_id) as session from d)
"""


@query(SESSIONS + "select user_id, cast(session as bigint) as session, min(us) as first_us, max(us) as last_us, count(*) as n from s group by user_id, session")
def win_gap_sessions(spark, sf):
    rows = TR.sessions(traj(spark, sf), "user_id", "us", ["us", "event_id"], 3_600_000_000)
    return rows.groupBy("user_id", "session").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))


BREAKS = SESSIONS + """, b as (select user_id, us from d where gap > 3600000000 union select user_id, us - gap from d where gap > 3600000000
 union select user_id, min(us) from d group by user_id union select user_id, max(us) from d group by user_id)"""


@query(BREAKS + "select user_id, us from b")
def win_gap_breakpoints(spark, sf):
    return TR.breakpoints(traj(spark, sf), "user_id", "us", ["us", "event_id"], 3_600_000_000)


INTERVALS = BREAKS + ", i as (select user_id, us as start_us, lead(us) over (partition by user_id order by us) as end_us from b)"


@query(INTERVALS + "select user_id, start_us, end_us from i where end_us is not null")
def win_swath_intervals(spark, sf):
    return TR.intervals(TR.breakpoints(traj(spark, sf), "user_id", "us", ["us", "event_id"], 3_600_000_000), "user_id", "us")


@query(INTERVALS + "select g.event_id, i.user_id, i.start_us from i join g on g.user_id = i.user_id and g.us between i.start_us and i.end_us where i.end_us is not null")
def join_range_breaks(spark, sf):
    rows = traj(spark, sf)
    spans = TR.intervals(TR.breakpoints(rows, "user_id", "us", ["us", "event_id"], 3_600_000_000), "user_id", "us")
    return TR.in_intervals(rows, spans, "user_id", "us").select("event_id", "user_id", "start_us")


SWATH = HEADING + f""", k as (select event_id, t.user_id, {MICROS} as us from v_traj t join o using (user_id) where yaw between y0 - 60 and y0 + 60 or yaw between y1 - 60 and y1 + 60),
 d as (select *, us - lag(us) over (partition by user_id order by us, event_id) as gap from k),
 b as (select user_id, us from d where gap > 3600000000 union select user_id, us - gap from d where gap > 3600000000
 union select user_id, min(us) from d group by user_id union select user_id, max(us) from d group by user_id),
 i as (select user_id, us as start_us, lead(us) over (partition by user_id order by us) as end_us from b)
"""


@query(SWATH + "select k.event_id, i.user_id, i.start_us, i.end_us from i join k on k.user_id = i.user_id and k.us between i.start_us and i.end_us where i.end_us is not null")
def cq_swath_split(spark, sf):
    flown = TR.heading_band(traj(spark, sf), "user_id", ["us", "event_id"], 60.0)
    spans = TR.intervals(TR.breakpoints(flown, "user_id", "us", ["us", "event_id"], 3_600_000_000), "user_id", "us")
    return TR.in_intervals(flown, spans, "user_id", "us").select("event_id", "user_id", "start_us", "end_us")


AZIMUTH = """
with p as (select *, lag(x) over w as px, lag(y) over w as py from v_vertices window w as (partition by fid order by vertex_ind)),
 d as (select *, x - px as dx, y - py as dy from p), a as (select fid, vertex_ind, case when dx = 0 or dy = 0 then null
  when dx > 0 and dy > 0 then degrees(atan(abs(dx) / abs(dy))) when dx > 0 then 180 - degrees(atan(abs(dx) / abs(dy)))
  when dy < 0 then 180 + degrees(atan(abs(dx) / abs(dy))) when dx < 0 then 360 - degrees(atan(abs(dx) / abs(dy))) end as az from d)
"""


@query(AZIMUTH + f"select fid, vertex_ind, {R6.format('az')} as azimuth from a")
def win_azimuth(spark, sf):
    return TR.azimuths(view(spark, sf, "v_vertices")).select("fid", "vertex_ind", G.rounded("azimuth").alias("azimuth"))


@query(AZIMUTH + """, n as (select *, lead(az) over (partition by fid order by vertex_ind) as nx from a)
select fid, vertex_ind, coalesce(abs(floor(nx) - floor(az)) > 20, false) as section from n""")
def win_direction_change(spark, sf):
    return TR.direction_changes(view(spark, sf, "v_vertices"), 20).select("fid", "vertex_ind", "section")


@query("""
select v.fid, v.vertex_ind, p.x as px, n.x as nx from v_vertices v join v_vertices p on p.fid = v.fid and p.vertex_ind = v.vertex_ind - 1
 join v_vertices n on n.fid = v.fid and n.vertex_ind = v.vertex_ind + 1""")
def join_self_lag(spark, sf):
    w = Window.partitionBy("fid").orderBy("vertex_ind")
    rows = view(spark, sf, "v_vertices").withColumns({"px": F.lag("x").over(w), "nx": F.lead("x").over(w)})
    return rows.where("px is not null and nx is not null").select("fid", "vertex_ind", "px", "nx")


@query("select fid, arg_min(x, vertex_ind) as x0, arg_min(y, vertex_ind) as y0, arg_max(x, vertex_ind) as x1, arg_max(y, vertex_ind) as y1 from v_vertices group by fid")
def win_first_last(spark, sf):
    at = lambda f, c, n: f(c, "vertex_ind").alias(n)
    return view(spark, sf, "v_vertices").groupBy("fid").agg(at(F.min_by, "x", "x0"), at(F.min_by, "y", "y0"), at(F.max_by, "x", "x1"), at(F.max_by, "y", "y1"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders")
def win_row_index(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return view(spark, sf, "orders").select("o_custkey", "o_orderkey", n.cast("long").alias("n"))


@query(f"""
with p as (select *, sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as d from v_vertices window w as (partition by fid order by vertex_ind))
select fid, count(*) as vertices, floor(coalesce(sum(d), 0) * 1e4 + 0.5) / 1e4 as length from p group by fid""")
def win_polyline_length(spark, sf):
    return TR.polyline_lengths(view(spark, sf, "v_vertices")).select("fid", "vertices", G.rounded("length", 4).alias("length"))


LINES = """
with p as (select *, lead(x) over w as nx, lead(y) over w as ny from v_vertices window w as (partition by fid order by vertex_ind)),
 s as (select *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as d from p where nx is not null),
 c as (select *, coalesce(sum(d) over (partition by fid order by vertex_ind rows between unbounded preceding and 1 preceding), 0) as bef from s),
 l as (select fid, sum(d) as len from c group by fid having sum(d) > 0),
 n as (select fid, len, cast(greatest(2, floor(len / 100) + 1) as bigint) as n from l),
 k as (select fid, len, n, unnest(range(n)) as k from n)
"""


@query("select fid, count(*) as n from (" + LINES + "select k.fid, k.k from k) t group by fid")
def smp_line_evenly_counts(spark, sf):
    return TR.sample_lines(view(spark, sf, "v_vertices"), 100.0).groupBy("fid").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + """, m as (select k.fid, k.k, k.len * k.k / k.n as pos from k), j as (
 select m.fid, m.k, m.pos, c.*, row_number() over (partition by m.fid, m.k order by c.bef desc, c.vertex_ind desc) as r from m join c on c.fid = m.fid and c.bef <= m.pos where c.d > 0)
select fid, k, floor((x + (nx - x) * (pos - bef) / d) * 1e3 + 0.5) / 1e3 as x, floor((y + (ny - y) * (pos - bef) / d) * 1e3 + 0.5) / 1e3 as y from j where r = 1""")
def smp_line_evenly(spark, sf):
    rows = TR.sample_lines(view(spark, sf, "v_vertices"), 100.0)
    return rows.select("fid", "k", G.rounded("x", 3).alias("x"), G.rounded("y", 3).alias("y"))


@query("select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey")
def sort_values(spark, sf):
    return view(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2")
def topk_max(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return view(spark, sf, "orders").withColumn("n", n).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("select c_custkey, cast(floor((row_number() over (order by c_custkey) - 1) / 120) as bigint) as chunk from customer")
def chunk_ids(spark, sf):
    return C.chunked(view(spark, sf, "customer"), "c_custkey", 120).select("c_custkey", "chunk")


@query("select s_nationkey as nation, string_agg(s_name, ',' order by s_name) as names from supplier group by s_nationkey")
def agg_string(spark, sf):
    return view(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"))


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey having count(*) = 1")
def agg_singletons(spark, sf):
    return view(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("o_orderkey")).where("n = 1").drop("n")


@query("select o_custkey, count(*) as n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from orders group by o_custkey having count(*) > 1")
def agg_duplicates(spark, sf):
    rows = view(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("k")).where("n > 1")
    return rows.select("o_custkey", "n", F.array_join(F.transform("k", lambda k: k.cast("string")), ",").alias("keys"))


@query("select split_part(p_name, ' ', 1) as kind, count(*) as n, string_agg(cast(p_partkey as varchar) || ':' || p_name, ';' order by p_partkey) as zones from part group by 1")
def agg_group_airspace(spark, sf):
    """Zones grouped by the first word of their name, each group with all its zones."""
    zone = F.struct("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name").alias("zone"))
    rows = view(spark, sf, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(zone)).alias("z"))
    return rows.select("kind", "n", F.array_join(F.transform("z", lambda z: z["zone"]), ";").alias("zones"))


@query("select fid, count(*) as n from v_vertices group by fid order by n desc, fid")
def agg_value_counts(spark, sf):
    return view(spark, sf, "v_vertices").groupBy("fid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fid")


@query("select o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (where o_orderstatus <> 'P') as first_price from orders group by o_custkey")
def agg_first_nonnull(spark, sf):
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    order = F.when(value.isNotNull(), F.struct("o_orderdate", "o_orderkey"))
    return view(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(value, order).alias("first_price"))


@query("""with c as (select o_orderstatus as status, o_custkey % 7 as v, count(*) as k from orders group by all)
select status, arg_min(v, (-k, v)) as common, cast(sum(k) as bigint) as n from c group by status""")
def agg_mode(spark, sf):
    """Of values that are equally frequent, the smallest is the mode."""
    counts = view(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("status").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("common"), F.sum("n").alias("n"))


@query("""
with e as (select numer, length, list_aggregate(list_transform(string_split(sasiedzi, ','), lambda s: case when cast(s as bigint) % 2 = 0 then 1 else 0 end), 'sum') as even from v_edges)
select even, floor(sum(cast(floor(length * 100) as bigint) * case when even <= 1 then 2 else 1 end) + 0.5) / 100 as total from e group by even""")
def agg_path_length(spark, sf):
    even = F.size(F.filter(F.split("sasiedzi", ","), lambda s: s.cast("long") % 2 == 0)).alias("even")
    rows = view(spark, sf, "v_edges").select(even, F.floor(F.col("length") * 100).alias("cm"))
    doubled = F.col("cm") * F.when(F.col("even") <= 1, 2).otherwise(1)
    return rows.groupBy("even").agg((F.sum(doubled).cast("double") / 100).alias("total"))


@query("select count(*) as total, count(*) filter (where c_acctbal < 0) as bad from customer")
def agg_count_summary(spark, sf):
    return view(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("bad"))


@query("""
select coalesce(case when o_orderpriority = '1-URGENT' then null else o_orderpriority end, '__NONE__') as note, o_orderstatus as status, count(*) as parts,
 min(o_orderkey) as first_key from orders where nullif(o_custkey, 7) is not null group by 1, 2""")
def agg_dissolve(spark, sf):
    """The keys of a dissolve: rows without the main key go, rows without a note are a group."""
    rows = view(spark, sf, "orders").withColumn("main", F.nullif("o_custkey", F.lit(7))).where("main is not null")
    note = F.coalesce(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")), F.lit("__NONE__"))
    return rows.groupBy(note.alias("note"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("parts"), F.min("o_orderkey").alias("first_key"))


@query("select c_custkey as key from customer except select o_custkey from orders where o_orderstatus = 'F'")
def set_difference(spark, sf):
    a = view(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return a.join(view(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")), "key", "left_anti").distinct()


HASH = """
with a as (select doc_id % 1000 as name, md5(text) as hash from documents where source in ('src0', 'src1')), b as (select doc_id % 1000 as name, md5(text) as hash from documents where source in ('src1', 'src2'))
select coalesce(a.name, b.name) as name, case when b.name is null then 'only_in_a' when a.name is null then 'only_in_b' when a.hash = b.hash then 'same' else 'changed' end as status
from a full join b on a.name = b.name"""


@query(HASH)
def cq_hash_audit(spark, sf):
    docs = view(spark, sf, "documents").select((F.col("doc_id") % 1000).alias("name"), F.md5("text").alias("hash"), "source")
    return C.compare_trees(docs.where("source in ('src0', 'src1')"), docs.where("source in ('src1', 'src2')"))


@query("select split_part(c_name, '#', 1) || '/' || (c_custkey % 7) as folder, count(*) as files, min(c_name) as first_file from customer group by 1")
def cq_flight_folders(spark, sf):
    folder = F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit("/"), (F.col("c_custkey") % 7).cast("string"))
    return view(spark, sf, "customer").groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min("c_name").alias("first_file"))


@query("select numer, len(string_split(sasiedzi, ',')) as neighbours, len(string_split(sasiedzi, ',')) <= 3 as hanging, length from v_edges")
def degree_table(spark, sf):
    n = F.size(F.split("sasiedzi", ","))
    return view(spark, sf, "v_edges").select("numer", n.cast("long").alias("neighbours"), (n <= 3).alias("hanging"), "length")


@query("select case when o_orderkey % 3 = 0 then 'rgb' else 'plain' end as layout, o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus else o_orderpriority end as cell from orders")
def cq_report_rows(spark, sf):
    rgb = F.col("o_orderkey") % 3 == 0
    return view(spark, sf, "orders").select(F.when(rgb, "rgb").otherwise("plain").alias("layout"), "o_orderkey", F.when(rgb, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("cell"))


#: What is advised for a finding; fixed by the documents.
ADVICE = {"PROMO": "replace", "STANDARD": "watch", "SMALL": "none"}


@query("""select p_partkey, case split_part(p_type, ' ', 1) when 'PROMO' then 'replace' when 'STANDARD' then 'watch' when 'SMALL' then 'none' end as advice from part""")
def join_lookup_dict(spark, sf):
    known = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return view(spark, sf, "part").select("p_partkey", F.try_element_at(known, F.split_part("p_type", F.lit(" "), F.lit(1))).alias("advice"))


@query("""
with a as (select doc_id % 777 as name, md5(text) as hash from documents where source = 'src3'), b as (select doc_id % 777 as name, md5(text) as hash from documents where source = 'src4')
select coalesce(a.name, b.name) as name, case when b.name is null then 'only_in_a' when a.name is null then 'only_in_b' when a.hash = b.hash then 'same' else 'changed' end as status
from a full join b on a.name = b.name""")
def join_full_outer_diff(spark, sf):
    docs = view(spark, sf, "documents").select((F.col("doc_id") % 777).alias("name"), F.md5("text").alias("hash"), "source")
    return C.compare_trees(docs.where("source = 'src3'"), docs.where("source = 'src4'"))


@query("select s_suppkey, case when exists (select 1 from customer where c_custkey = s_suppkey * 20) then 'merge' else 'copy' end as action from supplier")
def join_left_exists(spark, sf):
    old = view(spark, sf, "customer").select((F.col("c_custkey") / 20).alias("s_suppkey"), F.lit(True).alias("old"))
    rows = view(spark, sf, "supplier").select(F.col("s_suppkey").cast("double").alias("s_suppkey")).join(old, "s_suppkey", "left")
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.when(F.col("old"), "merge").otherwise("copy").alias("action"))


@query("select numer, len(string_split(sasiedzi, ',')) > 2 as multi from v_edges where len(string_split(sasiedzi, ',')) > 1")
def flt_geometry_type(spark, sf):
    parts = F.size(F.split("sasiedzi", ","))
    return view(spark, sf, "v_edges").where(parts > 1).select("numer", (parts > 2).alias("multi"))


@query("select c_custkey, c_acctbal / 100 as x, cast(c_custkey * 13 % 101 as double) as y, 0.0 as z from customer")
def geo_points_from_xy(spark, sf):
    point = F.struct((F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 13 % 101).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return view(spark, sf, "customer").select("c_custkey", point.alias("p")).select("c_custkey", "p.*")


@query("""with c as (select o_orderkey, cast(o_totalprice as bigint) as w, sum(cast(o_totalprice as bigint)) over (partition by o_orderstatus order by o_orderkey) as upto, o_orderstatus as s from orders),
 t as (select s, max(upto) as total from c group by s), k as (select s, total, unnest(range(10)) as k from t), q as (select s, k, total * (2 * k + 1) // 20 as pick from k)
select q.s as status, q.k, c.o_orderkey from q join c on c.s = q.s and c.upto > q.pick and c.upto - c.w <= q.pick""")
def join_asof(spark, sf):
    """The row whose share of a running total holds each of ten evenly spread picks."""
    rows = view(spark, sf, "orders").select("o_orderkey", F.bround("o_totalprice").cast("long").alias("w"), F.col("o_orderstatus").alias("status"))
    return C.inverse_cdf(C.running_total(rows, "w", "o_orderkey", by="status", name="upto"), "status", 10).select("status", "k", "o_orderkey")
