"""Validation and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gates as Q
from tessera.operators import relational as L
from tessera.operators import temporal as T
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query
from tessera.session import table


@query("""SELECT 'ERROR' AS severity, 'SHORT_TEXT' AS type, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS detail FROM documents WHERE length(trim(text)) < 20
UNION ALL SELECT 'WARN', 'DUPLICATE_TEXT', sha1(text), CAST(count(*) AS VARCHAR) FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'LABEL_WITHOUT_DOCUMENT', CAST(doc_id AS VARCHAR), NULL FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'WARN', 'LENGTH_MISMATCH', CAST(doc_id AS VARCHAR), CAST(length(text) AS VARCHAR) FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'INFO', 'UNLABELLED', lang, CAST(count(*) AS VARCHAR) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id) GROUP BY lang""")
def q_build_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG6: issues of the driver's tables as one table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    true = F.lit(True)
    dups = docs.groupBy(F.sha1("text").alias("sha")).agg(F.count("*").alias("n"))
    orphans = labels.join(docs.select("doc_id"), "doc_id", "left_anti")
    bare = docs.join(labels.select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))
    return Q.together(
        [
            Q.issue(docs, F.length(F.trim("text")) < 20, "ERROR", "SHORT_TEXT", F.col("doc_id"), F.col("n_chars")),
            Q.issue(dups, F.col("n") > 1, "WARN", "DUPLICATE_TEXT", F.col("sha"), F.col("n")),
            Q.issue(orphans, true, "ERROR", "LABEL_WITHOUT_DOCUMENT", F.col("doc_id")),
            Q.issue(docs, F.col("n_chars") != F.length("text"), "WARN", "LENGTH_MISMATCH", F.col("doc_id"), F.length("text")),
            Q.issue(bare, true, "INFO", "UNLABELLED", F.col("lang"), F.col("n")),
        ]
    )


@query("""SELECT NOT bool_or(length(trim(text)) < 20) AS passed, count(*) FILTER (length(trim(text)) < 20) AS n_error, CAST(0 AS BIGINT) AS n_warn, CAST(0 AS BIGINT) AS n_info FROM documents""")
def q_readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: whether every check holds."""
    docs = table(spark, sf_dir, "documents")
    return Q.gate(Q.issue(docs, F.length(F.trim("text")) < 20, "ERROR", "SHORT_TEXT", F.col("doc_id")), ["ERROR"])


_CATALOG = "path string, filename string, sha256 string, source_provider string, source_url string, collected_at string, reviewer string, reviewed_at string, review_evidence string, official_source boolean, authoritative boolean"
_CATALOG_ROWS = [
    ("a/1", "1", "s", "gov", "https://g/1", "2025-01-01", "r", "2025-02-01", "e", True, True),
    ("a/2", "2", "s", "gov", "http://g/2", "2025-01-01", "r", "2024-02-01", "e", False, True),
    ("a/3", "3", "", None, None, "2025-13-01", None, "", None, None, False),
]


@query(f"""WITH {cte("t", _CATALOG, _CATALOG_ROWS)} SELECT path, concat_ws(',', CASE WHEN coalesce(sha256, '') = '' THEN 'sha256' END, CASE WHEN coalesce(source_provider, '') = '' THEN 'source_provider' END, CASE WHEN coalesce(source_url, '') = '' THEN 'source_url' END,
CASE WHEN coalesce(collected_at, '') = '' THEN 'collected_at' END, CASE WHEN coalesce(reviewer, '') = '' THEN 'reviewer' END, CASE WHEN coalesce(reviewed_at, '') = '' THEN 'reviewed_at' END, CASE WHEN coalesce(review_evidence, '') = '' THEN 'review_evidence' END,
CASE WHEN authoritative AND NOT coalesce(official_source, false) THEN 'official_source' END, CASE WHEN collected_at <> '' AND TRY_CAST(collected_at AS DATE) IS NULL THEN 'valid_collected_at' END, CASE WHEN reviewed_at <> '' AND TRY_CAST(reviewed_at AS DATE) IS NULL THEN 'valid_reviewed_at' END,
CASE WHEN TRY_CAST(reviewed_at AS DATE) < TRY_CAST(collected_at AS DATE) THEN 'review_before_collection' END, CASE WHEN source_url <> '' AND NOT starts_with(source_url, 'https://') THEN 'https_source_url' END) AS missing_fields FROM t""")
def q_catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4, QG5: what catalog records lack."""
    rows = frame(spark, _CATALOG, _CATALOG_ROWS)
    return rows.select("path", F.array_join(Q.catalog_missing({c: F.col(c) for c in rows.columns}, F.col("authoritative")), ",").alias("missing_fields"))


@query("""WITH a AS (SELECT doc_id, quality AS q FROM labels), b AS (SELECT source, max(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT d.doc_id, coalesce(a.q, b.q) AS q FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (source)""")
def q_catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF10, JN4: a field from the row's own entry, else from its group's."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    own = labels.select("doc_id", F.col("quality").alias("q"))
    group = docs.join(labels, "doc_id").groupBy("source").agg(F.max("quality").alias("q"))
    return L.fallback_lookup(docs, [(own, ["doc_id"]), (group, ["source"])], ["q"]).select("doc_id", "q")


_GOLD = "query_id string, question string, query_type string, review_status string, reviewer string, reviewed_at string, build_id string, gold_unit_ids array<string>, expected_no_answer boolean, query_date string"
_GOLD_ROWS = [
    ("q1", "x?", "LOOKUP", "APPROVED", "r", "2025-01-01", "b", ["u"], False, None),
    ("q2", "", "TEMPORAL", "APPROVED", "", None, "b", [], False, None),
    ("q3", "y?", "INSUFFICIENT_FACTS", "DRAFT", None, None, None, [], False, None),
    ("q1", "z?", "AMENDMENT", "OTHER", None, None, None, [], True, "2024-01-01"),
]


@query(f"""WITH {cte("t", _GOLD, _GOLD_ROWS)} SELECT query_id, question, count(*) OVER (PARTITION BY query_id) > 1 AS repeated, concat_ws(',', CASE WHEN coalesce(question, '') = '' THEN 'MISSING_QUESTION' END, CASE WHEN review_status NOT IN ('DRAFT', 'APPROVED', 'REJECTED') THEN 'UNKNOWN_STATUS' END,
CASE WHEN review_status = 'APPROVED' AND (coalesce(reviewer, '') = '' OR coalesce(reviewed_at, '') = '' OR coalesce(build_id, '') = '') THEN 'APPROVED_WITHOUT_REVIEWER' END, CASE WHEN review_status = 'APPROVED' AND query_type <> 'INSUFFICIENT_FACTS' AND len(gold_unit_ids) = 0 THEN 'MISSING_QRELS' END,
CASE WHEN query_type = 'INSUFFICIENT_FACTS' AND NOT expected_no_answer THEN 'MUST_EXPECT_NO_ANSWER' END, CASE WHEN query_type IN ('TEMPORAL', 'AMENDMENT') AND coalesce(query_date, '') = '' THEN 'MISSING_DATE' END) AS problems FROM t""")
def q_gold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG11, AG2: what keeps gold questions from use."""
    rows = frame(spark, _GOLD, _GOLD_ROWS)
    counts = rows.groupBy("query_id").agg((F.count("*") > 1).alias("repeated"))
    out = rows.withColumn("problems", F.array_join(Q.gold_problems({c: F.col(c) for c in rows.columns}), ","))
    return out.join(counts, "query_id").select("query_id", "question", "repeated", "problems")


@query("""SELECT o_custkey, count(*) AS n, string_agg(DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '..' || o_orderstatus, ';' ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '..' || o_orderstatus) AS intervals,
sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS members_sha FROM orders GROUP BY o_custkey""")
def q_review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG14, QG15: review cases with their intervals and a hash of their members."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return Q.group_cases(orders, ["o_custkey"], "o_orderkey", ["day", "o_orderstatus"])


@query("""WITH p AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 5000 THEN 'LONG' END, CASE WHEN lang <> 'en' THEN 'FOREIGN' END, CASE WHEN contains(text, '@') THEN 'CONTACT' END, CASE WHEN n_chars < 200 THEN 'SHORT' END], lambda x: x IS NOT NULL)) AS pool FROM documents)
SELECT pool, doc_id, CAST(row_number() OVER (PARTITION BY pool ORDER BY doc_id) AS INTEGER) AS pick FROM p QUALIFY row_number() OVER (PARTITION BY pool ORDER BY doc_id) <= 2""")
def q_stratified_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG17: the first two rows of each of several overlapping pools."""
    pools = {"LONG": F.col("n_chars") > 5000, "FOREIGN": F.col("lang") != "en", "CONTACT": F.col("text").contains("@"), "SHORT": F.col("n_chars") < 200}
    return Q.stratified(table(spark, sf_dir, "documents"), pools, "doc_id", 2).select("pool", "doc_id", "pick")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS repeat FROM events)
SELECT event_type, count(*) FILTER (repeat) AS n_repeats, count(*) FILTER (NOT repeat) AS n_first FROM e GROUP BY event_type""")
def q_review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG12: first rows and repeats of keys in file order."""
    rows = Q.first_and_repeats(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.groupBy("event_type").agg(F.count_if("repeat").alias("n_repeats"), F.count_if(~F.col("repeat")).alias("n_first"))


_RECORD = "id int, temporal_verified boolean, valid_from string, valid_to string, legal_status string, version_role string, consolidation_as_of string, status_checked_at string"
_RECORD_ROWS = [
    (1, True, "2025-01-01", None, "EFFECTIVE", None, None, None), (2, True, "2020-01-01", "2025-01-01", "EXPIRED", None, None, None), (3, None, "2020-01-01", None, None, None, None, None),
    (4, True, "2020-01-01", None, "EXPIRED", None, None, None), (5, True, "2020-01-01", None, "PARTIALLY_EXPIRED", None, None, None), (6, True, "2020-01-01", None, "EFFECTIVE", "CONSOLIDATED", "2024-01-01", None),
    (7, True, "2020-01-01", None, "EFFECTIVE", None, None, "2022-01-01"), (8, True, "2020-1-1", None, "EFFECTIVE", None, None, None), (9, True, "2020-01-01", None, "UNKNOWN", None, None, None),
]


@query(f"""WITH {cte("t", _RECORD, _RECORD_ROWS)}, d AS (SELECT unnest([DATE '2022-12-31', DATE '2023-01-01', DATE '2025-01-01']) AS day)
SELECT id, day, coalesce(temporal_verified AND regexp_full_match(valid_from, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND legal_status IN ('EFFECTIVE', 'EXPIRED', 'PARTIALLY_EXPIRED') AND NOT (legal_status = 'EXPIRED' AND valid_to IS NULL)
 AND (version_role IS DISTINCT FROM 'CONSOLIDATED' OR day >= TRY_CAST(consolidation_as_of AS DATE)) AND (status_checked_at IS NULL OR valid_to IS NOT NULL OR day <= TRY_CAST(status_checked_at AS DATE))
 AND day >= TRY_CAST(valid_from AS DATE) AND (valid_to IS NULL OR day < TRY_CAST(valid_to AS DATE)), false) AS eligible FROM t, d""")
def q_temporal_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF5: point-in-time eligibility; whatever is unknown excludes."""
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("2022-12-31", "2023-01-01", "2025-01-01")])).alias("day")
    rows = frame(spark, _RECORD, _RECORD_ROWS).select("*", days)
    return rows.select("id", "day", T.eligible(F.col("day"), {c: F.col(c) for c in rows.columns}).alias("eligible"))
