"""Queries that run the streaming jobs over `events` to their end, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.streaming import streams

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _drained(spark, stream):
    folder = streams.workspace(spark)
    streams.drain(stream, folder)
    streams.drain(stream, folder)  # resumes, and finds nothing new
    return spark.read.parquet(f"{folder}/out")


@query("str_01_resumable_queue", "select event_id, user_id, case when value < 1 then 'failed' else 'completed' end as status from events")
def _(spark, d):
    return _drained(spark, streams.worked_queue(streams.events(spark, f"{d}/events.parquet")))


@query("str_02_ttl_dedupe", """
with recursive r as (select (user_id % 50) || ':' || event_type as key, ts from events), s as (
  select key, min(ts) as ts from r group by 1 union all select s.key, min(r.ts) from s join r on r.key = s.key and r.ts > s.ts + interval 24 hours group by s.key, s.ts)
select key, ts from s""")
def _(spark, d):
    rows = streams.events(spark, f"{d}/events.parquet").withColumn("key", F.concat_ws(":", F.expr("user_id % 50"), "event_type"))
    return _drained(spark, streams.answered_once(rows.select("key", "ts")))


@query("str_03_used_ids", "select review, identifier, event_id from (select user_id % 20 as review, event_type || (event_id % 30) as identifier, event_id, row_number() over (partition by user_id % 20, event_type || (event_id % 30) order by ts, event_id) as n from events) where n = 1")
def _(spark, d):
    rows = streams.events(spark, f"{d}/events.parquet").withColumns({"review": F.expr("user_id % 20"), "identifier": F.concat("event_type", F.expr("event_id % 30").cast("string"))})
    return _drained(spark, streams.unused(rows, "review", "identifier")).select("review", "identifier", "event_id")


@query("str_04_progress_stream", "select event_type, count(*) as attempts, count(*) filter (value >= 1) as successes from events group by 1")
def _(spark, d):
    stream = streams.counters(streams.events(spark, f"{d}/events.parquet"), "event_type")
    return streams.drain_counters(stream, streams.workspace(spark))
