"""Streaming queries, drained into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import query


@query("stream_volume", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_volume(spark: SparkSession, sf: str) -> DataFrame:
    out = E.drain(E.volume(E.read_events(spark, sf)), "complete", "volume")
    return out.select(F.to_timestamp_ntz(F.col("window_start").cast("string")).alias("window_start"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.deduplicated(E.read_events(spark, sf), ["event_id"]), "append", "dedup").select("event_id", "user_id", "event_type")


@query(
    "stream_sessions",
    "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = E.drain(E.sessions(E.read_events(spark, sf)), "complete", "sessions")
    return out.select("user_id", F.to_timestamp_ntz(F.col("session_start").cast("string")).alias("session_start"), "n")


@query("stream_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS decisions FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.latest_state(E.read_events(spark, sf)), "complete", "state").select("user_id", "state", "decisions")


@query("stream_history", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20 GROUP BY user_id")
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    out = E.drain(E.history(E.read_events(spark, sf)), "update", "history")
    return out.groupBy("user_id").agg(F.max_by("history", "batch").alias("history"))
