"""Streaming queries, drained once, with batch SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.plans.learning import SURPRISE
from mnemospark.plans.registry import query
from mnemospark.streaming import jobs as J


def _events(spark, sf):
    return J.event_stream(spark, f"{sf}/events.parquet")


@query("x01_stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(least(1.0, value / 100.0)), 6) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    out = J.run_once(J.tumbling(_events(spark, sf)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", S.rounded("mean").alias("mean"))


@query("x02_stream_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    out = J.run_once(J.sliding(_events(spark, sf)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x03_stream_sessions", "WITH t AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM t) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark, sf):
    out = J.run_once(J.sessions(_events(spark, sf)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("x04_stream_tiers", "SELECT event_type, user_id % 3 AS tier, count(*) AS n, round(avg(least(1.0, value / 100.0)), 6) AS mean FROM events GROUP BY 1, 2")
def stream_tiers(spark, sf):
    return J.run_once(J.running_tiers(_events(spark, sf)), "complete").select("event_type", "tier", "n", S.rounded("mean").alias("mean"))


@query("x05_stream_surprise", SURPRISE + "SELECT key AS user_id, n, promoted, round(momentum, 6) AS momentum FROM f")
def stream_surprise(spark, sf):
    out = J.run_once(J.running_surprise(_events(spark, sf)), "update", ["user_id"])
    return out.withColumn("momentum", S.rounded("momentum"))


@query("x06_stream_live_memory", "WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts FROM events), n AS MATERIALIZED (SELECT a.event_id AS event_id, b.event_id AS next_id FROM (SELECT *, ts + INTERVAL 48 HOUR AS until FROM e) a ASOF JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts >= a.until), r AS (SELECT event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 UNION ALL SELECT next_id FROM r JOIN n USING (event_id)) SELECT user_id, event_type, event_id, ts AS begun, ts + INTERVAL 48 HOUR AS until FROM r JOIN e USING (event_id)")
def stream_live_memory(spark, sf, hours: int = 48):
    """What opens each user's memories of a type, which live for two days."""
    out = J.run_once(J.live_memory(_events(spark, sf), hours), "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begun", "until")})
