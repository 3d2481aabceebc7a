"""Resolution of sources by a stream of outcomes, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.sources.scratch import scratch_path
from tessera.streaming import resolution as S


def event_outcomes(events: DataFrame) -> DataFrame:
    """Fetch outcomes out of events: a record is a user's day; the number in props names one of five candidates."""
    slot = F.coalesce(F.regexp_extract("props", r"(\d+)", 1).try_cast("int"), F.lit(0)) % 5
    kind, value = F.col("event_type"), F.coalesce("value", F.lit(0.0))
    role = F.when(slot == 0, "IDENTITY").when(slot == 1, "STATUS_HISTORY").otherwise("BINARY")
    good, doubtful = kind == "purchase", kind == "view"
    state = F.when(kind == "signup", "FETCH_PENDING").when(kind == "error", "BLOCKED").when(good & (slot > 1), "AUTO_EXACT_SHA").when(good, "FETCHED").otherwise("NEEDS_REVIEW")
    reason = F.when(kind == "error", F.when(value < 5, "HTTP_404").otherwise("FETCH_ERROR")).when(good | (kind == "signup"), F.lit(None)).when(slot < 2, "IDENTITY_NOT_FOUND").when(doubtful, "UNKNOWN_MAGIC").otherwise("SHA_MISMATCH")
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("record_id"),
        slot.cast("string").alias("candidate_id"),
        role.alias("role"),
        (slot == 2).alias("required"),
        F.when(slot < 4, "gazette").otherwise("mirror").alias("provider"),
        F.concat(F.lit("https://example.org/"), slot.cast("string")).alias("url"),
        state.alias("state"),
        F.array_compact(F.array(reason)).alias("reasons"),
        (good & (value >= 5)).alias("identity_match"),
        (good | (kind == "click")).alias("trusted"),
        F.col("event_id").alias("seq"),
    )


_SQL = """WITH e AS (SELECT *, coalesce(TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER), 0) % 5 AS slot, coalesce(value, 0) AS v, event_type AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS record_id, slot, event_id AS seq, slot > 1 AS bin, slot = 2 AS required, CASE WHEN slot < 4 THEN 'gazette' ELSE 'mirror' END AS provider,
  CASE WHEN k = 'signup' THEN 'FETCH_PENDING' WHEN k = 'error' THEN 'BLOCKED' WHEN k = 'purchase' AND slot > 1 THEN 'AUTO_EXACT_SHA' WHEN k = 'purchase' THEN 'FETCHED' ELSE 'NEEDS_REVIEW' END AS state,
  CASE WHEN k = 'error' THEN CASE WHEN v < 5 THEN 'HTTP_404' ELSE 'FETCH_ERROR' END WHEN k IN ('purchase', 'signup') THEN NULL WHEN slot < 2 THEN 'IDENTITY_NOT_FOUND' WHEN k = 'view' THEN 'UNKNOWN_MAGIC' ELSE 'SHA_MISMATCH' END AS reason,
  k = 'purchase' AND v >= 5 AS named, k IN ('purchase', 'click') AS trusted FROM e),
c AS (SELECT *, CASE state WHEN 'FETCH_PENDING' THEN 0 WHEN 'BLOCKED' THEN 1 ELSE 2 END AS kind FROM o),
l AS (SELECT *, kind = 2 AS evidence, CASE WHEN NOT trusted THEN 0 ELSE 2 + CASE WHEN state = 'AUTO_EXACT_SHA' THEN 2 ELSE 0 END + CASE WHEN named THEN 1 ELSE 0 END END AS rank FROM c
  QUALIFY row_number() OVER (PARTITION BY record_id, slot ORDER BY kind DESC, CASE WHEN kind = 2 THEN -seq ELSE seq END DESC) = 1),
b AS (SELECT record_id, slot AS chosen, state AS b_state, reason AS b_reason, rank FROM l WHERE bin AND evidence QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY rank DESC, length(provider), slot DESC) = 1),
g AS (SELECT record_id, bool_or(evidence AND named) AS identity_ok, bool_or(bin) AS has_binary, bool_or(bin AND kind > 0) AS tried, bool_or(bin AND evidence) AS not_blocked, bool_or(required AND kind = 0) AS pending,
  bool_or(state = 'NEEDS_REVIEW') AS review, bool_or(kind <> 1) AS other FROM l GROUP BY record_id),
d AS (SELECT *, coalesce(rank > 0, FALSE) AS ok FROM g LEFT JOIN b USING (record_id)),
s AS (SELECT *, CASE WHEN tried AND NOT not_blocked AND NOT ok THEN 'BLOCKED' WHEN chosen IS NULL AND pending THEN 'FETCH_PENDING' WHEN chosen IS NULL AND NOT review AND NOT other THEN 'BLOCKED' WHEN chosen IS NULL THEN 'NEEDS_REVIEW'
  WHEN b_state <> 'AUTO_EXACT_SHA' OR NOT identity_ok THEN 'NEEDS_REVIEW' ELSE 'AUTO_EXACT_SHA' END AS state,
  CASE WHEN tried AND NOT not_blocked AND NOT ok THEN NULL WHEN chosen IS NULL AND NOT pending AND NOT review AND NOT other THEN NULL WHEN chosen IS NULL THEN 'BINARY_NOT_FETCHED' WHEN b_state <> 'AUTO_EXACT_SHA' THEN b_reason WHEN NOT identity_ok THEN 'IDENTITY_FAILED' END AS added FROM d),
r AS (SELECT record_id, reason, FALSE AS bars FROM l WHERE kind > 0 AND reason IS NOT NULL UNION ALL SELECT record_id, added, FALSE FROM s WHERE added IS NOT NULL
  UNION ALL SELECT record_id, l.reason, TRUE FROM l JOIN s USING (record_id) WHERE l.kind = 1 AND NOT (s.ok AND s.identity_ok) AND (l.bin OR NOT s.has_binary)),
a AS (SELECT record_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (bars) AS blocking FROM r GROUP BY record_id)
SELECT record_id, s.state, coalesce(a.reasons, '') AS reasons, coalesce(a.blocking, '') AS blocking, CAST(chosen AS VARCHAR) AS candidate_id, identity_ok FROM s LEFT JOIN a USING (record_id)"""


@query(_SQL)
def q_resolver_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV5: outcomes read as a stream, candidates persisted by batch, and what their records come to."""
    target = scratch_path(spark, "candidates")
    # the path is a pattern because a stream takes a folder or a pattern, and the table may be one file; events without a
    # user or a time name no record
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").filter("user_id is not null and ts is not null")
    S.resolve_stream(event_outcomes(events), target, scratch_path(spark, "resolution")).awaitTermination()
    out = S.record_decisions(S.persisted(spark, target))
    return out.select("record_id", "state", F.array_join("reasons", ",").alias("reasons"), F.array_join("blocking", ",").alias("blocking"), "candidate_id", "identity_ok")
