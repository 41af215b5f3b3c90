"""Transitions of jobs, as a table and as a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.plans.registry import query
from inkframe.session import scratch, table
from inkframe.streaming import jobs

#: What the types of events ask for, and after how long a running job is stale. Fixed values.
WANTED = {"signup": "queued", "view": "running", "click": "review", "purchase": "completed", "error": "failed"}
STALE = timedelta(hours=2)


def requests(events: DataFrame) -> DataFrame:
    wanted = F.create_map(*(F.lit(x) for pair in WANTED.items() for x in pair))
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("at"), wanted[F.col("event_type")].alias("wanted"))


def counted(rows: DataFrame) -> DataFrame:
    """Per job and transition how often it was asked for and granted, and its first and last request."""
    return rows.groupBy("job", "before", "wanted", "stale").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if("granted").alias("granted"), F.min("request").alias("first"), F.max("request").alias("last"), F.sum(F.unix_micros("at") % 1000003).alias("times")
    )


_MAY = " OR ".join(f"({'state IS NULL' if before is None else f'state = {before!r}'} AND wanted IN ({', '.join(map(repr, after))}))" for before, after in jobs.ALLOWED.items() if after)
_WANTED = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in WANTED.items())
_SQL = f"""WITH RECURSIVE r AS MATERIALIZED (
  SELECT user_id AS job, event_id AS request, epoch_us(ts) AS moment, CASE event_type {_WANTED} END AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
fold AS (
  SELECT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS wanted, false AS granted,
    CAST(NULL AS VARCHAR) AS was, CAST(NULL AS BIGINT) AS ends, false AS gone, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS BIGINT) AS since FROM (SELECT DISTINCT job FROM r)
  UNION ALL
  SELECT job, k, request, moment, state, wanted, coalesce({_MAY}, false), was, ends, gone, CASE WHEN {_MAY} THEN wanted ELSE state END, CASE WHEN {_MAY} THEN moment ELSE since END FROM (
    SELECT r.job, r.k, r.request, r.moment, r.wanted, f.state AS was, f.since + 7200000000 AS ends, coalesce(f.state = 'running' AND r.moment > f.since + 7200000000, false) AS gone,
      CASE WHEN coalesce(f.state = 'running' AND r.moment > f.since + 7200000000, false) THEN 'failed' ELSE f.state END AS state,
      CASE WHEN coalesce(f.state = 'running' AND r.moment > f.since + 7200000000, false) THEN f.since + 7200000000 ELSE f.since END AS since
    FROM fold f JOIN r ON r.job = f.job AND r.k = f.k + 1)),
done AS (SELECT job, arg_max(state, k) AS state, arg_max(since, k) AS since FROM fold GROUP BY job),
o AS (
  SELECT job, request, moment, before, wanted, granted, false AS stale FROM fold WHERE k > 0
  UNION ALL SELECT job, NULL, ends, was, 'failed', true, true FROM fold WHERE gone
  UNION ALL SELECT job, NULL, since + 7200000000, state, 'failed', true, true FROM done WHERE state = 'running' AND since + 7200000000 < (SELECT max(moment) FROM r))
SELECT job, before, wanted, stale, count(*) AS asked, count(*) FILTER (granted) AS granted, min(request) AS first, max(request) AS last, CAST(sum(moment % 1000003) AS BIGINT) AS times FROM o GROUP BY ALL"""


@query(_SQL)
def job_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions that a log of requests was granted or refused, and jobs that went stale."""
    return counted(jobs.transitions(requests(table(spark, folder, "events")), STALE))


@query(_SQL)
def job_transition_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream of the events, with a state and a timer for each job."""
    path = f"{folder}/events.parque[t]"  # a pattern, as a stream of one file would need its folder
    stream = spark.readStream.schema(table(spark, folder, "events").schema).parquet(path)
    return counted(jobs.drain(jobs.stream_transitions(requests(stream), STALE), scratch(spark, "transitions"), scratch(spark, "state")))
