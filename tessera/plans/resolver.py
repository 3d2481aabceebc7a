"""Source-resolution queries over inline seeds and fetch logs, and page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as L
from tessera.operators import resolver as V
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query
from tessera.session import table

_SEED = "relative_path string, result string, url string, direct string"
_SEED_ROWS = [("a/1.pdf", "FOUND", "https://law.example/1", "https://law.example/1.pdf"), ("a/2.pdf", "NOT_FOUND", "", ""), ("a/3.pdf", "MULTIPLE", "https://x.example/3", ""), ("a/4.pdf", "FOUND", "", ""), ("a/5.pdf", "FOUND", "https://law.example/5", "https://law.example/5")]


@query(f"""WITH {cte("s", _SEED, _SEED_ROWS)} SELECT substr(sha256(relative_path), 1, 16) AS record_id, CASE WHEN result = 'NOT_FOUND' THEN 'NEEDS_DISCOVERY' WHEN result = 'MULTIPLE' THEN 'NEEDS_REVIEW'
WHEN url <> '' OR direct <> '' THEN 'FETCH_PENDING' ELSE 'NEEDS_DISCOVERY' END AS state FROM s""")
def q_seed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV1, SC12: record ids and first states."""
    return frame(spark, _SEED, _SEED_ROWS).select(V.record_id(F.col("relative_path")).alias("record_id"), V.initial_state(F.col("result"), [F.col("url"), F.col("direct")]).alias("state"))


@query(f"""WITH {cte("s", _SEED, _SEED_ROWS)}, c AS (SELECT relative_path AS record_id, 'IDENTITY' AS role, url, 0 AS ordinal FROM s WHERE url <> '' UNION ALL SELECT relative_path, 'BINARY', direct, 1 FROM s WHERE direct <> ''
UNION ALL SELECT 'a/1.pdf', 'BINARY', 'https://law.example/1.pdf', 2 UNION ALL SELECT 'a/2.pdf', 'BINARY', 'https://law.example/2.zip', 3)
SELECT record_id, role, url, CAST(min(ordinal) AS INTEGER) AS ordinal, role = 'BINARY' AND min(ordinal) = min(min(ordinal)) OVER (PARTITION BY record_id, role) AS required FROM c GROUP BY record_id, role, url""")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV2, RV3: candidates of seeds and overrides, first of each role and URL."""
    seeds = frame(spark, _SEED, _SEED_ROWS).withColumn("record_id", F.col("relative_path"))
    more = frame(spark, "record_id string, role string, url string, ordinal int", [("a/1.pdf", "BINARY", "https://law.example/1.pdf", 0), ("a/2.pdf", "BINARY", "https://law.example/2.zip", 1)])
    return V.candidates(seeds, [("IDENTITY", "url"), ("BINARY", "direct")], more).select("record_id", "role", "url", "ordinal", "required")


_PROVIDER = "provider_id string, domain string, path_glob string, roles array<string>, ordinal int"


@query(r"""SELECT page_id, url, CASE WHEN url LIKE 'https://%' THEN regexp_extract(lower(url), '^https://([^/:?#]+)', 1) END AS host FROM pages""")
def q_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN26: hosts of https pages."""
    host = F.when(F.col("url").startswith("https://"), F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))))
    return table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))


@query(r"""WITH p AS (SELECT regexp_extract(lower(url), '^https://([^/:?#]+)', 1) AS host, page_id, url, coalesce(nullif(regexp_extract(url, '^https://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages WHERE url LIKE 'https://%'),
even AS (SELECT DISTINCT host AS domain FROM p WHERE host <> '' AND length(host) % 2 = 0)
SELECT page_id, url, CASE WHEN host IN (SELECT domain FROM even) THEN host END AS provider FROM p UNION ALL SELECT page_id, url, NULL FROM pages WHERE url NOT LIKE 'https://%' OR url IS NULL""")
def q_url_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF13, PF14, WN9: the first provider that allows a page's URL (hosts of even length are providers)."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    hosts = pages.filter(F.col("url").startswith("https://")).select(host.alias("domain")).filter("domain is not null").distinct()
    providers = hosts.filter("length(domain) % 2 = 0").select(F.col("domain").alias("provider_id"), "domain", F.lit("/*").alias("path_glob"), F.array(F.lit("IDENTITY")).alias("roles"), F.lit(0).alias("ordinal"))
    return V.url_allowed(F.col("url"), F.lit("IDENTITY"), providers, pages.select("page_id", "url")).select("page_id", "url", "provider")


_LOG = "candidate_id string, record_id string, provider string, url string, authority_ok boolean, identity_ok boolean, kind string, sha string, expected string, content_ok boolean, secondary boolean"
_LOG_ROWS = [
    ("c1", "r1", "gov", "https://g/1", True, True, "PDF", "aa", "aa", True, False),
    ("c2", "r1", "mirror", "https://m/1", True, True, "PDF", "bb", "aa", True, False),
    ("c3", "r2", "gov", "https://g/2", True, False, "PDF", "aa", "aa", True, False),
    ("c4", "r3", "blog", "https://b/3", False, True, None, None, "cc", False, False),
    ("c5", "r4", "gov", "https://g/4", True, True, None, None, "dd", False, False),
    ("c6", "r5", "copy", "https://c/5", True, True, "PDF", "ee", "ee", True, True),
    ("c7", "r4", "gov", "https://g/5", True, True, "ZIP", "ff", "dd", True, False),
]
_DECIDED = f"""{cte("t", _LOG, _LOG_ROWS)}, d AS (SELECT *, CASE WHEN secondary THEN 'NEEDS_REVIEW' WHEN NOT authority_ok THEN 'BLOCKED_AUTHORITY' WHEN NOT identity_ok THEN 'NEEDS_REVIEW' WHEN kind IS NULL THEN 'BINARY_PENDING'
  WHEN sha = expected THEN 'AUTO_EXACT_SHA' WHEN content_ok THEN 'AUTO_CONTENT_MATCH' ELSE 'NEEDS_REVIEW' END AS state FROM t)"""


def _decided(spark: SparkSession) -> DataFrame:
    c = F.col
    state = V.decide(c("authority_ok"), c("identity_ok"), c("kind").isNotNull(), F.coalesce(c("sha") == c("expected"), F.lit(False)), c("content_ok"), c("secondary"))
    return frame(spark, _LOG, _LOG_ROWS).withColumn("state", state)


@query(f"WITH {_DECIDED} SELECT candidate_id, state FROM d")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV6: a state for every fetched candidate."""
    return _decided(spark).select("candidate_id", "state")


@query(f"""WITH {_DECIDED} SELECT record_id, CASE WHEN bool_or(state = 'AUTO_EXACT_SHA') THEN 'AUTO_EXACT_SHA' WHEN bool_or(state = 'AUTO_CONTENT_MATCH') THEN 'AUTO_CONTENT_MATCH' WHEN bool_or(state = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW'
WHEN bool_or(state = 'BLOCKED_AUTHORITY') THEN 'BLOCKED_AUTHORITY' ELSE 'FETCH_PENDING' END AS state, coalesce(string_agg(DISTINCT CASE WHEN sha <> expected THEN 'SHA_MISMATCH' END, ','), '') AS reasons FROM d GROUP BY record_id""")
def q_resolver_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV5: record states and reasons from the candidates' states."""
    rows = _decided(spark).withColumn("reasons", F.array_compact(F.array(F.when(F.col("sha") != F.col("expected"), F.lit("SHA_MISMATCH")))))
    return V.record_states(rows).select("record_id", "state", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_DECIDED}, r AS (SELECT record_id, candidate_id, provider, url, CASE state WHEN 'AUTO_EXACT_SHA' THEN 5 WHEN 'AUTO_CONTENT_MATCH' THEN 4 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 0 END AS rank FROM d)
SELECT record_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rank DESC, length(provider), provider DESC, url DESC, candidate_id DESC) AS k FROM r) WHERE k = 1""")
def q_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK8: the best candidate by a ranked tuple."""
    rank = F.when(F.col("state") == "AUTO_EXACT_SHA", 5).when(F.col("state") == "AUTO_CONTENT_MATCH", 4).when(F.col("state") == "NEEDS_REVIEW", 2).otherwise(0)
    return V.best_candidate(_decided(spark).withColumn("rank", rank), ["record_id"]).select("record_id", "candidate_id", "rank")


@query("""WITH h AS (SELECT user_id, event_id, event_type, event_id % 5 <> 0 AS old FROM events), u AS (SELECT user_id, arg_max(event_type, struct_pack(a := NOT old, b := event_id)) AS state, count(*) AS n FROM h GROUP BY user_id) SELECT user_id, state FROM u""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6: the latest state of each key after a batch is merged in (every fifth event is the batch)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return L.upsert(events.filter("event_id % 5 <> 0"), events.filter("event_id % 5 = 0"), ["user_id"], ["state"], [], "event_id")


@query("""WITH have AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id < 5000), come AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id >= 5000 GROUP BY ALL)
SELECT user_id, event_type, CAST(-1 AS BIGINT) AS event_id FROM have UNION ALL SELECT user_id, event_type, event_id FROM come c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.user_id = c.user_id AND h.event_type = c.event_type)""")
def q_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7: a batch's rows whose key isn't there yet."""
    events = table(spark, sf_dir, "events")
    have = events.filter("event_id < 5000").select("user_id", "event_type").distinct().withColumn("event_id", F.lit(-1).cast("long"))
    come = events.filter("event_id >= 5000").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return L.insert_if_absent(have, come, ["user_id", "event_type"])


_PAGE = "id int, expected string, page string, content_type string, lead string, size long"
_PAGE_ROWS = [(1, "45/2019/QH14", "Luật số 45/2019/QH14 ...", "application/pdf", "%PDF-1.7", 100), (2, "45/2019/QH14", "so 45-2019-qh14", "text/html", "%PDF-1.4", 100), (3, "1/2020/ND-CP", "khác", "application/zip", "PK\x03\x04", 99999999), (4, "", "any", None, "<html>", 5)]


@query(f"""WITH {cte("t", _PAGE, _PAGE_ROWS)} SELECT id, expected <> '' AND (contains(lower(page), lower(expected)) OR contains(regexp_replace(lower(page), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), regexp_replace(lower(expected), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) AS identity,
CASE WHEN starts_with(lead, '%PDF') THEN 'PDF' WHEN starts_with(lead, 'PK' || chr(3) || chr(4)) THEN 'ZIP' END AS kind,
concat_ws(',', CASE WHEN size > 26214400 THEN 'TOO_LARGE' END, CASE WHEN NOT starts_with(lead, '%PDF') AND NOT starts_with(lead, 'PK') THEN 'UNKNOWN_MAGIC' END, CASE WHEN starts_with(lead, '%PDF') AND NOT contains(content_type, 'pdf') THEN 'MIME_MISMATCH' END) AS reasons FROM t""")
def q_binary_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN27, FN28: identity in a page's text, file kinds by leading bytes, and what is wrong with a file."""
    c, none = F.col, F.lit(None).cast("string")
    content = c("lead").cast("binary")
    reasons = V.binary_reasons(content, c("content_type"), none, none, c("size"))
    return frame(spark, _PAGE, _PAGE_ROWS).select("id", V.identity_matches(c("expected"), c("page")).alias("identity"), V.file_kind(content).alias("kind"), F.array_join(reasons, ",").alias("reasons"))
