"""Streaming queries: each drains the event files with an availableNow trigger and
returns the sink table it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import events as st
from .registry import register

AS_OF = "2024-01-31 00:00:00"
KEYS = ["user_id", "event_type"]


def _sink(spark, sf_dir, path: str):
    """Read a stream's sink; a stream that wrote nothing reads as an empty events table."""
    schema = st.file_stream(spark, sf_dir, "events").schema     # partition columns of a sink are not asked for
    return st.read_or_empty(spark, path, schema)


def _paths(spark, name: str):
    run = uuid.uuid4().hex
    return shared_dir(spark, "streams", name, run, "out"), shared_dir(spark, "streams", name, run, "checkpoint")


@register("stream_ingest", sql="""
with r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events)
select user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from r where rn = 1""")
def q_stream_ingest(spark, sf_dir):
    """Incremental insert-if-absent by (user, event type): first event per key wins."""
    out, ckpt = _paths(spark, "ingest")
    st.run_to_end(st.ingest_first_seen(st.file_stream(spark, sf_dir, "events"), KEYS, ["ts", "event_id"], out, ckpt))
    return _sink(spark, sf_dir, out).select("user_id", "event_type", "event_id",
                                            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("stream_dedup", sql="""
select distinct user_id, event_type from events""")
def q_stream_dedup(spark, sf_dir, delay: str = "7 days"):
    """One row per (user, event type) within a 7-day watermark (bounded state).  Which
    duplicate survives depends on arrival order, so the keys are what is reported."""
    out, ckpt = _paths(spark, "dedup")
    st.run_to_end(st.dedup_within_watermark(st.file_stream(spark, sf_dir, "events"), KEYS, delay, out, ckpt))
    return _sink(spark, sf_dir, out).select("user_id", "event_type")


SESSION_DAYS, DELAY_DAYS = 3, 2


@register("stream_first_events", sql=f"""
with g as (select *, case when ts < lag(ts) over w + interval {SESSION_DAYS} day then 0 else 1 end as begins from events
           window w as (partition by user_id, event_type order by ts, event_id)),
s as (select *, sum(begins) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as session from g),
e as (select user_id, event_type, session, min_by(event_id, struct_pack(ts, event_id)) as event_id, min(ts) as ts, max(ts) + interval {SESSION_DAYS} day as session_end,
             count(*) as n_events from s group by all)
select user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, strftime(session_end, '%Y-%m-%d %H:%M:%S') as session_end, n_events
from e where session_end <= (select max(ts) - interval {DELAY_DAYS} day from events)""")
def q_stream_first_events(spark, sf_dir):
    """The first event of every closed session of a (user, event type), whole: sessions end three days after
    their last event and are written once the watermark, two days behind, has passed that."""
    out, ckpt = _paths(spark, "sessions")
    stream = st.file_stream(spark, sf_dir, "events")
    st.run_to_end(st.first_of_sessions(stream, KEYS, ["ts", "event_id"], f"{SESSION_DAYS} days", f"{DELAY_DAYS} days", out, ckpt))
    schema = stream.schema.add("session_end", "timestamp").add("n_events", "long")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return st.read_or_empty(spark, out, schema).select("user_id", "event_type", "event_id", text("ts"), text("session_end"), "n_events")


@register("stream_recent", sql=f"""
select event_id, user_id, event_type from events where ts >= timestamp '{AS_OF}' - interval 7 day""")
def q_stream_recent(spark, sf_dir, as_of: str = AS_OF, days: int = 7):
    """Events of the last ``days`` before ``as_of`` (stateless event-time filter)."""
    out, ckpt = _paths(spark, "recent")
    st.run_to_end(st.recent(st.file_stream(spark, sf_dir, "events"), as_of, days, out, ckpt))
    return _sink(spark, sf_dir, out).select("event_id", "user_id", "event_type")
