"""Queries over text, scalar functions, and records from semi-structured text."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.functions import text as X
from terrasift.operators import text as T
from terrasift.plans.fixtures import view
from terrasift.plans.registry import query


@query("""
with b as (select doc_id, string_split(text, chr(10)) as parts from documents), p as (select doc_id, list_filter(list_transform(parts, lambda s: trim(s)), lambda s: s <> '') as parts from b),
 n as (select doc_id, unnest(parts) as block, unnest(range(len(parts))) as block_no from p)
select doc_id, block_no, md5(block) as hash from n""")
def scan_text_blocks(spark, sf):
    rows = T.text_blocks(view(spark, sf, "documents"), "doc_id", "text", r"\n")
    return rows.select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.md5("block").alias("hash"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '0') as k, coalesce(json_extract_string(props, '$.missing'), 'NA') as missing from events")
def json_extract_default(spark, sf):
    get = lambda path, default, name: F.coalesce(F.get_json_object("props", path), F.lit(default)).alias(name)
    return view(spark, sf, "events").select("event_id", get("$.k", "0", "k"), get("$.missing", "NA", "missing"))


@query("""select c_custkey, trim(c_name) as trimmed, rtrim(c_name, '0123456789') as stem, replace(c_name, '#', '-') as replaced, starts_with(c_name, 'Cust') as cust, upper(c_name) as upper_name,
 strpos(c_name, '#') as at, substr(c_name, strpos(c_name, '#') + 1, 4) as cut, split_part(c_name, '#', 1) as first_part, lpad(cast(c_custkey as varchar), 6, '0') as padded from customer""")
def fn_string(spark, sf):
    name = F.col("c_name")
    return view(spark, sf, "customer").select(
        "c_custkey",
        F.trim(name).alias("trimmed"),
        F.rtrim(name, F.lit("0123456789")).alias("stem"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"),
        F.startswith(name, F.lit("Cust")).alias("cust"),
        F.upper(name).alias("upper_name"),
        F.instr(name, "#").cast("long").alias("at"),
        F.substr(name, F.instr(name, "#") + 1, F.lit(4)).alias("cut"),
        F.split_part(name, F.lit("#"), F.lit(1)).alias("first_part"),
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"),
    )


@query(r"""select page_id, regexp_extract(url, '^(\w+)://', 1) as scheme, regexp_replace(url, '[0-9]+', '#', 'g') as masked, len(regexp_extract_all(html, '<p[ >]')) as paragraphs,
 coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), 'none') as title from pages""")
def fn_regex(spark, sf):
    html, url = F.col("html"), F.col("url")
    return view(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(url, r"^(\w+)://", 1).alias("scheme"),
        F.regexp_replace(url, "[0-9]+", "#").alias("masked"),
        F.regexp_count(html, F.lit("<p[ >]")).cast("long").alias("paragraphs"),
        F.coalesce(X.first_match(html, r"(?s)<title>(.*?)</title>", r"(?s)<h1[^>]*>(.*?)</h1>"), F.lit("none")).alias("title"),
    )


@query("select n_nationkey, translate('Żółć ' || n_name || ' łąka', 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ') as name from nation")
def fn_translit(spark, sf):
    return view(spark, sf, "nation").select("n_nationkey", X.plain(F.concat(F.lit("Żółć "), "n_name", F.lit(" łąka"))).alias("name"))


@query("""select event_id, floor((event_id % 90 + event_id % 60 / 60.0 + event_id % 59 / 3600.0) * case when event_id % 2 = 0 then 1 else -1 end * 1e6 + 0.5) / 1e6 as lat from events""")
def fn_angle_dms(spark, sf):
    e = F.col("event_id")
    text = F.concat_ws(":", (e % 90).cast("string"), (e % 60).cast("string"), (e % 59).cast("string"))
    text = F.concat(text, F.when(e % 2 == 0, " N").otherwise(" S"))
    return view(spark, sf, "events").select("event_id", G.rounded(G.dms_to_degrees(text)).alias("lat"))


@query("""select event_id, floor((event_id % 90 + (event_id % 60 + 0.25) / 60) * case when event_id % 3 = 0 then -1 else 1 end * 1e6 + 0.5) / 1e6 as lon from events""")
def fn_angle_ddmm(spark, sf):
    e = F.col("event_id")
    text = F.concat((e % 90).cast("string"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(".25"), F.when(e % 3 == 0, "W").otherwise("E"))
    return view(spark, sf, "events").select("event_id", G.rounded(G.ddmm_to_degrees(text)).alias("lon"))


@query("""with h as (select event_id, event_id % 361 as heading, event_id % 120 - 60 as roll from events)
select event_id, case when heading > 180 then heading - 360 else heading end as heading, case when roll < 0 then 180 + roll else roll - 180 end as roll from h""")
def fn_heading_normalize(spark, sf):
    rows = view(spark, sf, "events").select("event_id", (F.col("event_id") % 361).alias("heading"), (F.col("event_id") % 120 - 60).alias("roll"))
    return rows.select("event_id", G.signed_heading("heading").alias("heading"), G.flipped_roll("roll").alias("roll"))


@query("select event_id, floor(value) as low, ceil(value) as high, abs(value - 50) as off, floor(sqrt(value) * 1e6 + 0.5) / 1e6 as root, floor(atan(value) * 1e6 + 0.5) / 1e6 as angle, isfinite(value) as finite from events")
def fn_math(spark, sf):
    v = F.col("value")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return view(spark, sf, "events").select(
        "event_id", F.floor(v).cast("double").alias("low"), F.ceil(v).cast("double").alias("high"), F.abs(v - 50).alias("off"),
        G.rounded(F.sqrt(v)).alias("root"), G.rounded(F.atan(v)).alias("angle"), finite.alias("finite"),
    )


@query("""with d as (select event_id, cast(ts as date) as day, epoch_us(ts) as us from events), w as (select *, cast(floor(date_diff('day', date '1980-01-06', day) / 7) as bigint) as week from d)
select event_id, week, event_id % 604800 + week * 604800 + 18 - 1000000000 as adjusted from w""")
def fn_datetime(spark, sf):
    rows = view(spark, sf, "events").select("event_id", X.gps_week(F.to_date("ts")).alias("week"))
    return rows.withColumn("adjusted", X.gps_time(F.col("week"), F.col("event_id") % 604800))


@query("select c_custkey, try_cast(split_part(c_name, '#', 2) as bigint) as number, try_cast(c_name as double) is null as bad, try_cast(replace(cast(c_acctbal as varchar), '.', ',') as double) is null as comma from customer")
def fn_numeric_parse(spark, sf):
    comma = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return view(spark, sf, "customer").select(
        "c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("bigint").alias("number"),
        F.col("c_name").try_cast("double").isNull().alias("bad"), comma.try_cast("double").isNull().alias("comma"),
    )


@query("select r, c, coalesce(band1, 0) as filled, nullif(band2, 100) is null as hundred, coalesce(nullif(src, 'P'), 'other') as src from v_raster")
def fn_null(spark, sf):
    return view(spark, sf, "v_raster").select(
        "r", "c", F.coalesce("band1", F.lit(0)).alias("filled"), F.nullif(F.col("band2"), F.lit(100)).isNull().alias("hundred"),
        F.coalesce(F.nullif(F.col("src"), F.lit("P")), F.lit("other")).alias("src"),
    )


@query("""with l as (select numer, string_split(sasiedzi, ',') as l from v_edges)
select numer, len(l) as n, list_position(l, cast(numer + 7 as varchar)) as at, array_to_string(list_sort(list_distinct(l)), ',') as uniq, list_min(list_transform(l, lambda x: cast(x as bigint))) as least from l""")
def fn_array(spark, sf):
    items = F.split("sasiedzi", ",")
    return view(spark, sf, "v_edges").select(
        "numer", F.size(items).cast("long").alias("n"), F.array_position(items, (F.col("numer") + 7).cast("string")).alias("at"),
        F.array_join(F.sort_array(F.array_distinct(items)), ",").alias("uniq"), F.array_min(F.transform(items, lambda x: x.cast("long"))).alias("least"),
    )


@query("select numer, try_cast(part as bigint) as neighbour from (select numer, unnest(string_split(sasiedzi, ',')) as part from v_edges)")
def cq_split_rows(spark, sf):
    return T.split_rows(view(spark, sf, "v_edges"), "sasiedzi").select("numer", F.col("sasiedzi").try_cast("bigint").alias("neighbour"))


@query("select doc_id, md5(text) as hash, md5(coalesce(source, '')) as source_hash from documents")
def fn_hash(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), F.md5(F.coalesce("source", F.lit(""))).alias("source_hash"))


@query("""
select o_orderkey, code, x, y, z from (select o_orderkey, 'RD' as code, o_totalprice / 10 as x, cast(o_custkey as double) as y, 1.5 as z from orders
 union all select o_orderkey, 'RDS', case when o_orderstatus <> 'P' then o_totalprice / 20 end, o_custkey + 0.5, 2.5 from orders
 union all select o_orderkey, 'GPS', (o_totalprice / 10 + o_custkey) / 2, 0.0, 0.0 from orders) where x is not null""")
def cq_measure_unpivot(spark, sf):
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    codes = {
        "RD": (price / 10, cust.cast("double"), F.lit(1.5)),
        "RDS": (F.when(F.col("o_orderstatus") != "P", price / 20), cust + F.lit(0.5), F.lit(2.5)),
        "GPS": ((price / 10 + cust) / 2, F.lit(0.0), F.lit(0.0)),
    }
    return T.unpivot_points(view(spark, sf, "orders"), "o_orderkey", codes)


@query("select c_custkey, cast(c_custkey as varchar) as id, c_name || '!' as name, cast(c_nationkey as varchar) as nation, 3 as fields from customer")
def cq_kv_blocks(spark, sf):
    lines = F.concat_ws(
        "\n", F.lit("Parcel:"), F.concat(F.lit("id: "), "c_custkey"), F.lit("Owner:"), F.concat(F.lit("name: "), "c_name"),
        F.concat(F.lit("name: "), "c_name", F.lit("!")), F.concat(F.lit("nation: "), "c_nationkey"),
    )
    rows = T.key_value_records(view(spark, sf, "customer").select("c_custkey", lines.alias("text")), "c_custkey", "text")
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.select("c_custkey", f("Parcel.id").alias("id"), f("Owner.name").alias("name"), f("Owner.nation").alias("nation"), F.size("fields").alias("fields"))


@query("""select s_suppkey, 0 as block_no, 'R' as class, s_name as name, 'GND' as low, cast(s_nationkey * 100 as varchar) as high, 2 as vertices,
 floor((50 + (s_suppkey % 60) / 60.0 + 30 / 3600.0) * 1e6 + 0.5) / 1e6 as lat, floor((15 + s_nationkey % 5 + 0.5) * 1e6 + 0.5) / 1e6 as lon from supplier""")
def cq_airspace(spark, sf):
    text = F.concat(
        F.lit("AC R\nAN "), "s_name", F.lit("\nAL GND\nAH "), (F.col("s_nationkey") * 100).cast("string"),
        F.lit("\nDP 50:"), (F.col("s_suppkey") % 60).cast("string"), F.lit(":30 N "), (F.lit(15) + F.col("s_nationkey") % 5).cast("string"),
        F.lit(":30:00 E\nDP 51:00:00 N 016:00:00 E\n\nAC Q\nAN without vertices\n"),
    )
    rows = T.airspaces(view(spark, sf, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")
    first = F.get("vertices", F.lit(0))
    return rows.select(
        "s_suppkey", "block_no", "class", "name", "low", "high", F.size("vertices").alias("vertices"),
        G.rounded(first["lat"]).alias("lat"), G.rounded(first["lon"]).alias("lon"),
    )


@query("""select p_partkey, replace(p_brand, '#', '-') || '.pdf' as file, cast(p_partkey as varchar) as number, p_type as damage, 'A' || (p_partkey % 9) as panel, cast(p_size as double) as least,
 case when p_partkey % 2 = 0 then p_size + 1.5 end as mean, case when p_partkey % 3 = 0 then p_size + 3.0 end as most from part""")
def cq_pdf_records(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Nazwa pliku: "), F.col("p_brand"), F.lit(".pdf\nNumer wskazania: "), k.cast("string"), F.lit("\n"),
        F.when(k % 2 == 0, F.concat(F.lit("Uszkodzenie: "), "p_type", F.lit("\nPomiar\n"))).otherwise(F.concat(F.lit("Rodzaj: "), "p_type", F.lit("\n"))),
        F.lit("Panel: A"), (k % 9).cast("string"), F.lit("\nMIN: "), F.col("p_size").cast("string"),
        F.when(k % 4 == 0, F.concat(F.lit("\nŚrednia: "), (F.col("p_size") + F.lit(1.5)).cast("string"))).when(k % 2 == 0, F.concat(F.lit("\nAVERAGE: "), (F.col("p_size") + F.lit(1.5)).cast("string"))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit("\nMAX: "), (F.col("p_size") + F.lit(3.0)).cast("string"))).otherwise(""),
    )
    rows = view(spark, sf, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("-")))
    return T.page_records(rows.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("select conv_id, string_agg(text, chr(10) order by turn) as joined from conversations where turn > 0 group by conv_id")
def text_union_skip_header(spark, sf):
    """Files joined line by line without the first line of each."""
    rows = view(spark, sf, "conversations").where("turn > 0")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("joined"))


@query("select n_name || '.las' as name, 3 - (n_nationkey % 3) as parts, split_part(n_name, 'A', 1) as before from nation")
def fn_name_parts(spark, sf):
    return view(spark, sf, "nation").select(
        F.concat("n_name", F.lit(".las")).alias("name"), (F.lit(3) - F.col("n_nationkey") % 3).alias("parts"), F.split_part("n_name", F.lit("A"), F.lit(1)).alias("before")
    )
