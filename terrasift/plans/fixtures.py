"""Survey-shaped projections of the driver's tables, as SQL that Spark and DuckDB both run.

``{table}`` stands for a Parquet table. ``EDGES`` is the ring of ``v_polys``, an L-shaped polygon per box.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_points": """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as pt_key,
 l_extendedprice/1000 as x, l_quantity*2 + cast(l_linenumber as double)/10 as y, l_discount*100 + l_tax*10 as z,
 case l_returnflag when 'A' then 2 when 'N' then 1 else 5 end as classification,
 l_partkey % 4 as red, l_suppkey % 5 as green, l_linenumber % 3 as blue, l_shipdate as ts,
 concat(l_linestatus, cast(l_linenumber as string)) as file from {lineitem}""",
    "v_boxes": """
select s_suppkey as poly_id, s_name as name, cast(s_suppkey*37 % 97 as double) as xmin, cast(s_suppkey*53 % 89 as double) as ymin,
 cast(s_suppkey*37 % 97 + 3 + s_nationkey % 5 as double) as xmax, cast(s_suppkey*53 % 89 + 3 + s_nationkey % 5 as double) as ymax from {supplier}""",
    "v_polys": """
select poly_id, name, xmin, ymin, xmax, ymax, k as edge_no,
 case k when 0 then xmin when 1 then xmax when 2 then xmax when 3 then (xmin+xmax)/2 when 4 then (xmin+xmax)/2 else xmin end as x1,
 case k when 0 then ymin when 1 then ymin when 2 then (ymin+ymax)/2 when 3 then (ymin+ymax)/2 when 4 then ymax else ymax end as y1,
 case k when 0 then xmax when 1 then xmax when 2 then (xmin+xmax)/2 when 3 then (xmin+xmax)/2 when 4 then xmin else xmin end as x2,
 case k when 0 then ymin when 1 then (ymin+ymax)/2 when 2 then (ymin+ymax)/2 when 3 then ymax when 4 then ymax else ymin end as y2
 from {v_boxes} cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) e""",
    "v_traj": "select event_id, user_id, ts, (value*7 % 360) - 180 as yaw from {events}",
    "v_codes": """
select event_id as id, case event_type when 'click' then 'RD' when 'view' then 'RDS' when 'purchase' then 'RGS' when 'signup' then 'RL' else 'XX' end as kod,
 cast(user_id % 50 as double)*2 + cast(event_id % 97 as double)/97 as x, cast(event_id % 101 as double) as y, value/10 as z from {events}""",
    "v_segments": """
select line_id, seq, x1, y1, x2, y2 from (select c_nationkey as line_id, row_number() over (partition by c_nationkey order by c_custkey) as seq,
 c_acctbal/100 as x1, cast(c_custkey*13 % 101 as double) as y1,
 lead(c_acctbal/100) over (partition by c_nationkey order by c_custkey) as x2,
 lead(cast(c_custkey*13 % 101 as double)) over (partition by c_nationkey order by c_custkey) as y2 from {customer}) t where x2 is not null""",
    "v_ditches": """
select line_id, seq, x1, y1, x2, y2, concat('R', line_id % 9) as oznaczenie, nullif(line_id % 8, 5) as id_zlewni,
 case line_id % 4 when 0 then null when 1 then 'Rurociąg grawitacyjny' else concat('uwaga ', line_id % 4) end as uwagi from {v_segments}""",
    "v_vertices": """
select o_custkey as fid, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as vertex_ind,
 o_totalprice/1000 as x, cast(o_orderkey % 500 as double) as y from {orders}""",
    "v_raster": """
select cast(floor(o_orderkey/125) as bigint) as r, o_orderkey % 125 as c,
 case when o_orderpriority = '1-URGENT' then null else o_custkey % 256 end as band1, cast(floor(o_totalprice/1000) as bigint) as band2,
 o_orderstatus as src from {orders}""",
    "v_edges": """
select c_custkey as numer, concat_ws(',', c_custkey+1, c_custkey+7, c_custkey+c_nationkey) as sasiedzi, c_acctbal+1000 as length from {customer}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a plain table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, after the definitions of the projections that it names."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in needed)
    text = sql.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {text[15:]}"
    return f"with {ctes}, {text[4:]}" if text.lower().startswith("with ") else f"with {ctes} {text}"
