"""Streaming queries: each one processes what is there and returns the result as a table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from terrasift.plans.fixtures import view
from terrasift.plans.registry import query
from terrasift.streaming import sessions as ST


def _events(spark, sf):
    schema = view(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("""
with d as (select user_id, epoch_us(ts) as us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events),
 s as (select *, sum(case when gap > 3600000000 then 1 else 0 end) over (partition by user_id order by us rows unbounded preceding) as session from d)
select user_id, min(us) as first_us, max(us) as last_us, count(*) as n from s group by user_id, session""")
def stream_gap_sessions(spark, sf):
    """Each session is appended once, when the watermark passes its end; a heartbeat after the last event ends the open ones."""
    to = ST.folder(spark)
    rows = _events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    beats = ST.heartbeats(spark, f"{to}/beats").select(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), "ts")
    found = ST.gap_sessions(rows.union(beats), "user_id", "ts", 3_600_000_000)
    found = found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")
    schema = found.schema
    ST.run_available(found, to)
    last = view(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    if last is not None:
        ST.beat(spark, f"{to}/beats", last + timedelta(hours=2))  # the gap, the lateness allowed, and some more
        ST.run_available(found, to)
    return spark.read.schema(schema).parquet(f"{to}/rows")


@query("select event_id, event_type from events where event_type = 'purchase'")
def stream_tail(spark, sf):
    to = ST.folder(spark)
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type").alias("value")
    view(spark, sf, "events").select(line).write.text(f"{to}/log")
    parts = F.split("value", ",")
    lines = ST.tail(spark, f"{to}/log").select(F.get(parts, F.lit(0)).cast("long").alias("event_id"), F.get(parts, F.lit(1)).alias("event_type"))
    lines = lines.where("event_type = 'purchase'")
    schema = lines.schema
    ST.run_available(lines, to)
    return spark.read.schema(schema).parquet(f"{to}/rows")


@query("select event_type, count(*) as n from events group by event_type")
def stream_incremental(spark, sf):
    """Files are taken once: a second run over the same folder finds nothing left to do."""
    to = ST.folder(spark)
    for _ in range(2):
        ST.run_available(_events(spark, sf).select("event_type"), to)
    return spark.read.schema("event_type string").parquet(f"{to}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
