"""Event-time queries, over tables as over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming.ingest import event_windows, user_sessions


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of one hour."""
    return event_windows(table(spark, sf_dir, "events"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def q_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after thirty quiet minutes."""
    return user_sessions(table(spark, sf_dir, "events"))
