"""Queries over streams: the events are read as a stream, state is kept, and what comes out is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query, rounded
from quarry.session import shared_folder
from quarry.streaming import windows as ST


def event_stream(t: Tables):
    return ST.read_table_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema)


def drained(t: Tables, stream, mode: str = "append"):
    return ST.drained(stream, shared_folder(t.spark), shared_folder(t.spark), mode)


@query("enter_leave_stream", "SELECT user_id, event_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'signup' AND nx = 'purchase'")
def enter_leave_stream(t: Tables):
    return drained(t, ST.paired_stream(event_stream(t), "signup", "purchase")).select("user_id", "event_id")


@query("kept_counts_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kept_counts_stream(t: Tables):
    changes = drained(t, ST.kept_counts(event_stream(t)), "update")
    return changes.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


@query("audit_stream", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def audit_stream(t: Tables):
    path = shared_folder(t.spark)
    ST.append_audit(event_stream(t), path, shared_folder(t.spark)).awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("alarm_stream", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 90")
def alarm_stream(t: Tables):
    return drained(t, ST.alarms(event_stream(t), "error", 90)).select("event_id", "value")


@query("window_stream", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_stream(t: Tables):
    last = drained(t, ST.windowed_counts(event_stream(t), "1 day"), "update")
    one = last.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("l"))
    return one.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "l.n", rounded(F.col("l.total"), 2).alias("total"))


@query("session_stream", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS session_start, count(*) AS n FROM s GROUP BY user_id, session")
def session_stream(t: Tables):
    found = ST.session_counts(ST.with_event_time(t.events), "30 minutes")
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").cast("string").alias("session_start"), "n")
