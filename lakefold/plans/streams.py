"""Event windows in batch mode over the events table; the same functions take streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefold.session import configure
from lakefold.sources.tables import load
from lakefold.streaming import events as E

from .registry import query


def _events(spark, d):
    configure(spark)
    return load(spark, d, "events")[0]


def _plain(df, *times):
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, d):
    return _plain(E.tumbling(_events(spark, d)), "start").withColumn("total", F.round("total", 4))


@query("select time_bucket(interval 30 minute, ts) - to_minutes(30 * k::int) as start, event_type, count(*) as n from events, (select unnest([0, 1]) as k) group by all")
def stream_sliding(spark, d):
    return _plain(E.sliding(_events(spark, d)), "start")


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
s as (select *, sum(opens) over (partition by user_id order by ts) as k from e)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def stream_sessions(spark, d):
    return _plain(E.sessions(_events(spark, d)), "start", "end")
