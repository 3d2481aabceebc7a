"""Audits of a build and of a resolution, over small tables that violate every check at least once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audits as A
from tessera.operators import resolver as V
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query

_CAND = "candidate_id string, record_id string, role string, requested_url string, final_url string, state string, reason_codes array<string>, parent_candidate_id string, allowed boolean, required boolean, m_role string, m_url string, m_final string, m_state string, m_codes array<string>"
_CAND_ROWS = [
    ("c1", "r1", "BINARY", "https://a/1", "https://a/1.pdf", "FETCHED", [], "", True, True, "BINARY", "https://a/1", "https://a/1.pdf", "FETCHED", []),
    ("c2", "r1", "IDENTITY", "https://a/2", "", "FETCHED", ["IDENTITY_MISMATCH", "HTTP_404"], "c1", True, False, "IDENTITY", "https://a/2", "", "FETCHED", ["HTTP_404", "IDENTITY_MISMATCH"]),
    ("c3", "r2", "STATUS_HISTORY", "https://a/3", "", "FETCHED", [], "c9", False, False, "STATUS_HISTORY", "https://a/3", "", "FETCHED", ["VBPL_HOME_SHELL"]),
    ("c4", "r2", "BINARY", "https://b/4", "", "FETCH_PENDING", ["ODD_CODE"], "", True, True, "BINARY", "https://b/4", "", "DISCOVERED", ["ODD_CODE"]),
    ("c5", "r3", "BINARY", "https://b/5", "", "BLOCKED", ["PROVIDER_NOT_ALLOWED"], "", False, True, "BINARY", "https://b/5", "", "BLOCKED", ["PROVIDER_NOT_ALLOWED"]),
    ("c6", "r3", "BINARY", "https://b/5", "", "FAILED", ["ENCODING_ERROR"], "", True, False, "BINARY", "https://b/5", "", "FAILED", ["ENCODING_ERROR"]),
    ("c7", "r3", "OTHER", "https://c/7", None, "DISCOVERED", None, None, False, None, "OTHER", "https://c/7", "", "DISCOVERED", None),
]
_REC = "record_id string, state string"
_REC_ROWS = [("r1", "AUTO_EXACT_SHA"), ("r2", "FETCH_PENDING"), ("r3", "BLOCKED"), ("r4", None)]
_EXP = "record_id string, state string, final_binary_url string, binary_authority_verified boolean, identity_match string, binary_candidate_id string, resolved_sha_match string, resolved_downloaded_sha256 string, blocking_reason_codes array<string>"
_EXP_ROWS = [
    ("r1", "AUTO_EXACT_SHA", "https://a/1.pdf", True, "YES", "c1", "YES", "s1", []),
    ("r2", "AUTO_EXACT_SHA", "https://a/x.HTML?y=1", False, None, "c1", "NO", "", ["HTTP_404"]),
    ("r3", "NEEDS_REVIEW", None, None, None, "", None, None, None),
]
_EVT = "evidence_id string"
_EVT_ROWS = [("e1",), ("e2",), ("e2",), ("e2",)]
_OVR = "id string, problems array<string>"
_OVR_ROWS = [("o1", []), ("o2", ["NOT_HTTPS"])]
_KNOWN = (*V.KNOWN_REASONS, "IDENTITY_NOT_FOUND", "VBPL_HOME_SHELL", "DOCUMENT_NOT_FOUND", "PROVIDER_NOT_ALLOWED")
_CODE_ERRORS = ("ENCODING_ERROR",)

_HAS = "list_has_any(coalesce(reason_codes, []), {})".format


@query(f"""WITH {cte("c", _CAND, _CAND_ROWS)}, {cte("r", _REC, _REC_ROWS)}, {cte("x", _EXP, _EXP_ROWS)}, {cte("e", _EVT, _EVT_ROWS)}, {cte("o", _OVR, _OVR_ROWS)},
v AS (SELECT 0 AS ordinal, count(*) AS observed FROM c WHERE coalesce(role, '') <> coalesce(m_role, '') OR coalesce(requested_url, '') <> coalesce(m_url, '') OR coalesce(final_url, '') <> coalesce(m_final, '') OR coalesce(state, '') <> coalesce(m_state, '') OR list_sort(coalesce(reason_codes, [])) <> list_sort(coalesce(m_codes, []))
UNION ALL SELECT 1, count(*) FROM c WHERE state = 'FETCHED' AND role IN ('IDENTITY', 'STATUS_HISTORY') AND {_HAS("['IDENTITY_NOT_FOUND', 'IDENTITY_MISMATCH', 'VBPL_HOME_SHELL', 'DOCUMENT_NOT_FOUND']")}
UNION ALL SELECT 2, count(*) FROM c WHERE state = 'FETCHED' AND ({_HAS("['VBPL_HOME_SHELL']")} OR list_contains(coalesce(m_codes, []), 'VBPL_HOME_SHELL'))
UNION ALL SELECT 3, count(*) FROM x WHERE regexp_matches(lower(final_binary_url), '^[^?]*[.]html?([?]|$)')
UNION ALL SELECT 4, count(*) FROM x WHERE state = 'AUTO_EXACT_SHA' AND NOT binary_authority_verified UNION ALL SELECT 5, count(*) FROM x WHERE state = 'AUTO_EXACT_SHA' AND identity_match IS DISTINCT FROM 'YES'
UNION ALL SELECT 6, count(*) FROM x WHERE binary_candidate_id <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.record_id = x.record_id AND c.candidate_id = x.binary_candidate_id)
UNION ALL SELECT 7, count(*) FROM x WHERE resolved_sha_match = 'NO' AND coalesce(resolved_downloaded_sha256, '') = '' UNION ALL SELECT 8, count(*) FROM x WHERE resolved_sha_match IN ('YES', 'NO') AND len(blocking_reason_codes) > 0
UNION ALL SELECT 9, count(*) FROM c WHERE parent_candidate_id <> '' AND parent_candidate_id NOT IN (SELECT candidate_id FROM c)
UNION ALL SELECT 10, count(*) - count(DISTINCT (record_id, role, requested_url)) FROM c UNION ALL SELECT 11, count(*) - count(DISTINCT evidence_id) FROM e UNION ALL SELECT 12, count(*) FROM o WHERE len(problems) > 0
UNION ALL SELECT 13, count(*) FROM c WHERE role IN ('IDENTITY', 'BINARY', 'STATUS_HISTORY') AND NOT coalesce(allowed, false) AND NOT (state = 'BLOCKED' AND {_HAS("['PROVIDER_NOT_ALLOWED']")})
UNION ALL SELECT 14, count(*) FROM c WHERE len([y FOR y IN coalesce(reason_codes, []) IF NOT (list_contains([{", ".join(f"'{k}'" for k in _KNOWN)}], y) OR regexp_full_match(y, 'HTTP_[1-5][0-9][0-9]'))]) > 0
UNION ALL SELECT 15, count(*) FROM c WHERE {_HAS("['ENCODING_ERROR']")} UNION ALL SELECT 16, count(*) FROM r WHERE coalesce(state, '') NOT IN ('AUTO_EXACT_SHA', 'AUTO_CONTENT_MATCH', 'NEEDS_REVIEW', 'BLOCKED')
UNION ALL SELECT 17, count(*) FROM c WHERE required AND state IN ('DISCOVERED', 'FETCH_PENDING'))
SELECT [{", ".join(f"'{g}'" for g in A.RESOLVER_GATES)}][ordinal + 1] AS gate, CAST(ordinal AS INTEGER) AS ordinal, observed, CAST(0 AS BIGINT) AS expected, observed = 0 AS passed FROM v""")
def q_resolver_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV9, AG18: the eighteen gates of a resolution."""
    rows = frame(spark, _CAND, _CAND_ROWS)
    meta = F.struct(F.col("m_role").alias("role"), F.col("m_url").alias("requested_url"), F.col("m_final").alias("final_url"), F.col("m_state").alias("state"), F.col("m_codes").alias("reason_codes"))
    rows = rows.withColumn("meta", meta).drop("m_role", "m_url", "m_final", "m_state", "m_codes")
    found = A.resolver_violations(rows, frame(spark, _REC, _REC_ROWS), frame(spark, _EXP, _EXP_ROWS), frame(spark, _EVT, _EVT_ROWS), frame(spark, _OVR, _OVR_ROWS), _KNOWN, _CODE_ERRORS)
    return A.verdicts(found, A.RESOLVER_GATES)


_REG = "document_id string, file_id string, source_group string, document_type string, document_number string, instrument_number string, title string, issuer string, promulgated_date string, source_url string, status string, effective_from string, effective_to string, valid_from string, valid_to string, consolidation_as_of string, version_role string, metadata_verified boolean, temporal_verified boolean"
_REG_ROWS = [
    ("d1", "f1", "LEGAL_DOCUMENT", "LAW", "1/2020/QH14", "1/2020/QH14", "Law", "Q", "2020-01-01", "https://x", "IN_FORCE", "2020-07-01", None, "2020-07-01", None, None, "ORIGINAL", True, True),
    ("d2", "f2", "LEGAL_DOCUMENT", "DECREE", "", None, "", "Q", "2020-13-01", None, "UNKNOWN", "2021-01-01", "2020-01-01", "2021-01-02", "2021-01-02", None, "ORIGINAL", False, None),
    ("d3", "f3", "CONSOLIDATED", "CONSOLIDATED", None, "3", "Text", "Q", "2020-01-01", "https://x", None, None, None, None, None, "", "CONSOLIDATED", True, True),
    ("d4", "f4", "JUDICIAL", "JUDGMENT", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("d4", "f4", "JUDICIAL", "JUDGMENT", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]
_EXT = "file_id string, text_chars int"
_EXT_ROWS = [("f1", 5000), ("f2", 99), ("f3", 1199)]
_PRV = "provision_id string, document_id string, level string, parent_id string, provision_identity_id string, provenance_status string, segment_type string, canonical_path string, segment_id string, char_start int, char_end int, text string"
_PRV_ROWS = [
    ("p1", "d1", "ARTICLE", "d1", "i1", "RESOLVED", "MAIN_BODY", "d1/1", "s1", 0, 9, "Article 1"),
    ("p2", "d1", "CLAUSE", "p1", "i2", "RESOLVED", "MAIN_BODY", "d1/1/1", "s1", 10, 22, "1. First\ntwo"),
    ("p3", "d1", "POINT", "p1", "i3", "UNRESOLVED", "ANNEX", "d1/1/1", "s1", 10, 18, "1. Other"),
    ("p4", "d9", "ARTICLE", "d9", None, None, None, "", None, 0, 1, "x"),
    ("p2", "d3", "CLAUSE", "p9", "", "RESOLVED", "MAIN_BODY", "d3/1", "s9", 0, 3, "abc"),
    ("p5", "d3", "ARTICLE", "d3", "i5", "RESOLVED", "MAIN_BODY", "d3/2", "s1", 10, 99, "1. First"),
]
_SEG = "segment_id string, document_id string, text string"
_SEG_ROWS = [("s1", "d1", "Article 1\n1. First\n\ntwo")]
_NOD = "id string"
_NOD_ROWS = [("d1",), ("p1",), ("p2",)]
_EDG = "id string, source string, target string, confidence double"
_EDG_ROWS = [("e1", "p1", "d1", 0.9), ("e2", "p1", "zz", 0.5), ("e3", "yy", "zz", None)]
_UNT = "unit_id string, breadcrumb string, provenance string, segment_type string"
_UNT_ROWS = [("u1", "a", "b", "MAIN_BODY"), ("u2", "", "b", "MAIN_BODY"), ("u1", "a", None, "MAIN_BODY")]


@query(f"""WITH {cte("g", _REG, _REG_ROWS)}, {cte("x", _EXT, _EXT_ROWS)}, {cte("p", _PRV, _PRV_ROWS)}, {cte("n", _NOD, _NOD_ROWS)}, {cte("e", _EDG, _EDG_ROWS)},
d AS (SELECT g.*, coalesce(text_chars, 0) AS chars FROM g LEFT JOIN x USING (file_id)), q AS (SELECT DISTINCT provision_id, level, document_id FROM p)
SELECT 'ERROR' AS severity, 'NO_MACHINE_TEXT' AS type, document_id AS id, CAST(chars AS VARCHAR) AS detail FROM d WHERE chars < 100
UNION ALL SELECT 'WARN', 'LOW_MACHINE_TEXT', document_id, CAST(chars AS VARCHAR) FROM d WHERE chars >= 100 AND chars < 1200
UNION ALL SELECT 'WARN', 'MISSING_DOCUMENT_NUMBER', document_id, NULL FROM d WHERE source_group = 'LEGAL_DOCUMENT' AND coalesce(document_number, '') = ''
UNION ALL SELECT 'WARN', 'MISSING_EFFECTIVE_FROM', document_id, NULL FROM d WHERE source_group = 'LEGAL_DOCUMENT' AND coalesce(effective_from, '') = ''
UNION ALL SELECT 'WARN', 'UNKNOWN_LEGAL_STATUS', document_id, NULL FROM d WHERE source_group = 'LEGAL_DOCUMENT' AND coalesce(status, '') IN ('', 'UNKNOWN')
UNION ALL SELECT 'ERROR', 'DUPLICATE_DOCUMENT_ID', document_id, CAST(count(*) AS VARCHAR) FROM g GROUP BY document_id HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'DUPLICATE_PROVISION_ID', provision_id, CAST(count(*) AS VARCHAR) FROM p GROUP BY provision_id HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'INVALID_PROVISION_PARENT', p.provision_id, NULL FROM p LEFT JOIN q ON q.provision_id = p.parent_id WHERE NOT coalesce(p.document_id IN (SELECT document_id FROM g) AND ((p.level = 'ARTICLE' AND p.parent_id = p.document_id)
  OR (q.document_id = p.document_id AND (p.level, q.level) IN (('CLAUSE', 'ARTICLE'), ('POINT', 'CLAUSE')))), false)
UNION ALL SELECT 'ERROR', 'MISSING_PROVISION_IDENTITY', provision_id, NULL FROM p WHERE coalesce(provision_identity_id, '') = '' UNION ALL SELECT 'ERROR', 'UNRESOLVED_PROVISION_PROVENANCE', provision_id, NULL FROM p WHERE provenance_status = 'UNRESOLVED'
UNION ALL SELECT 'ERROR', 'NO_ARTICLE_PARSED', document_id, NULL FROM g WHERE document_type IN ('LAW', 'DECREE', 'CIRCULAR', 'RESOLUTION', 'CONSOLIDATED', 'HISTORICAL') AND document_id NOT IN (SELECT document_id FROM p)
UNION ALL SELECT 'ERROR', 'DANGLING_EDGE', id, NULL FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)""")
def q_build_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG1, QG6: what is wrong with a build's documents, provisions and edges."""
    t = lambda c, r: frame(spark, c, r)
    return A.build_issues(t(_REG, _REG_ROWS), t(_EXT, _EXT_ROWS), t(_PRV, _PRV_ROWS), t(_NOD, _NOD_ROWS), t(_EDG, _EDG_ROWS))


def _missing_sql(field: str) -> str:
    return f"SELECT 'MISSING_{field.upper()}' AS type, document_id AS id, CAST(NULL AS VARCHAR) AS detail FROM d WHERE coalesce({field}, '') = ''"


def _date_sql(field: str) -> str:
    return f"SELECT 'INVALID_DATE', document_id, '{field}' FROM d WHERE {field} <> '' AND TRY_CAST({field} AS DATE) IS NULL"


@query(f"""WITH {cte("g", _REG, _REG_ROWS)}, {cte("p", _PRV, _PRV_ROWS)}, {cte("s", _SEG, _SEG_ROWS)}, {cte("n", _NOD, _NOD_ROWS)}, {cte("e", _EDG, _EDG_ROWS)}, {cte("u", _UNT, _UNT_ROWS)},
d AS (SELECT * FROM g WHERE source_group IN ('LEGAL_DOCUMENT', 'CONSOLIDATED')), h AS (SELECT p.*, s.text AS source FROM p LEFT JOIN s USING (segment_id) WHERE char_start IS NOT NULL AND char_end IS NOT NULL AND coalesce(segment_id, '') <> ''),
i AS ({" UNION ALL ".join(map(_missing_sql, A.REQUIRED_FIELDS))} UNION ALL {" UNION ALL ".join(map(_date_sql, A.DATE_FIELDS))}
UNION ALL SELECT 'UNVERIFIED_METADATA', document_id, NULL FROM d WHERE NOT coalesce(metadata_verified, false) UNION ALL SELECT 'UNVERIFIED_TEMPORAL_METADATA', document_id, NULL FROM d WHERE NOT coalesce(temporal_verified, false)
UNION ALL SELECT 'TEMPORAL_CONTRADICTION', document_id, NULL FROM d WHERE TRY_CAST(effective_to AS DATE) <= TRY_CAST(effective_from AS DATE) UNION ALL SELECT 'TEMPORAL_VALIDITY_CONTRADICTION', document_id, NULL FROM d WHERE TRY_CAST(valid_to AS DATE) <= TRY_CAST(valid_from AS DATE)
UNION ALL SELECT 'MISSING_CONSOLIDATION_AS_OF', document_id, NULL FROM d WHERE version_role = 'CONSOLIDATED' AND coalesce(consolidation_as_of, '') = ''
UNION ALL SELECT 'TEMPORAL_ALIAS_MISMATCH', document_id, 'effective_from' FROM d WHERE coalesce(effective_from, '') <> coalesce(valid_from, '') UNION ALL SELECT 'TEMPORAL_ALIAS_MISMATCH', document_id, 'effective_to' FROM d WHERE coalesce(effective_to, '') <> coalesce(valid_to, '')
UNION ALL SELECT 'NON_MAIN_BODY_PROVISION', provision_id, NULL FROM p WHERE segment_type IS DISTINCT FROM 'MAIN_BODY' UNION ALL SELECT 'MISSING_CANONICAL_PATH', provision_id, NULL FROM p WHERE coalesce(canonical_path, '') = ''
UNION ALL SELECT 'DUPLICATE_CANONICAL_PATH', canonical_path, CAST(count(*) AS VARCHAR) FROM p WHERE canonical_path <> '' GROUP BY canonical_path HAVING count(*) > 1
UNION ALL SELECT 'MISSING_PROVISION_PROVENANCE', provision_id, NULL FROM p WHERE char_start IS NULL OR char_end IS NULL OR coalesce(segment_id, '') = ''
UNION ALL SELECT 'INVALID_PROVISION_PROVENANCE', provision_id, NULL FROM h WHERE NOT coalesce(char_start < char_end AND char_end <= length(source) AND [trim(y) FOR y IN string_split(source[char_start + 1 : char_end], chr(10)) IF trim(y) <> ''] = [trim(y) FOR y IN string_split(text, chr(10)) IF trim(y) <> ''], false)
UNION ALL SELECT 'RELATION_BELOW_THRESHOLD', id, CAST(confidence AS VARCHAR) FROM e WHERE confidence < 0.55 UNION ALL SELECT 'DANGLING_RELATION', id, NULL FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)
UNION ALL SELECT 'DUPLICATE_UNIT_ID', unit_id, CAST(count(*) AS VARCHAR) FROM u GROUP BY unit_id HAVING count(*) > 1 UNION ALL SELECT 'INCOMPLETE_RETRIEVAL_METADATA', unit_id, NULL FROM u WHERE coalesce(breadcrumb, '') = '' OR coalesce(provenance, '') = '' OR coalesce(segment_type, '') = '')
SELECT 'ERROR' AS severity, type, id, detail FROM i""")
def q_semantic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG2, QG13: metadata, dates, spans, relations and units that contradict themselves."""
    t = lambda c, r: frame(spark, c, r)
    relations = t(_EDG, _EDG_ROWS).select(F.col("id").alias("edge_id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "confidence")
    return A.semantic_issues(t(_REG, _REG_ROWS), t(_PRV, _PRV_ROWS), t(_SEG, _SEG_ROWS), relations, t(_NOD, _NOD_ROWS), t(_UNT, _UNT_ROWS))


_EVD = "id string, document_id string, status string, evidence string, segment_id string, segment_start int, segment_end int, document_start int, document_end int, page_start int, page_end int"
_EVD_ROWS = [
    ("a", "d1", "RESOLVED", "First", "s1", 13, 18, 20, 25, 2, 2),
    ("b", "d1", "VERIFIED", "First", "s1", 12, 17, 20, 25, 2, 2),
    ("c", "d1", "RESOLVED", "First", "s9", None, None, 19, 24, 2, 2),
    ("d", "d1", "RESOLVED", "First", None, None, None, 20, 25, 1, 2),
    ("e", "d1", "UNRESOLVED", None, None, None, None, None, None, None, None),
    ("f", "d2", "RESOLVED", "plain", None, None, None, 0, 5, None, None),
    ("g", "d1", "RESOLVED", "1\n1. F", None, None, None, 15, 21, 1, 2),
]
_SRC = "document_id string, text string"
_SRC_ROWS = [("d1", "Header\nArticle 1\n1. First\n\ntwo"), ("d2", "plain text")]
_PAG = "document_id string, page int, text_start int, text_end int"
_PAG_ROWS = [("d1", 1, 0, 16), ("d1", 2, 17, 30)]


_EVIDENCE_SQL = f"""WITH {cte("v", _EVD, _EVD_ROWS)}, {cte("s", _SEG, _SEG_ROWS)}, {cte("d", _SRC, _SRC_ROWS)}, {cte("g", _PAG, _PAG_ROWS)},
a AS (SELECT v.*, s.text AS st, d.text AS dt, (SELECT count(*) FROM g WHERE g.document_id = v.document_id) AS n, (SELECT min(page) FROM g WHERE g.document_id = v.document_id AND text_start < document_end AND text_end > document_start) AS lo,
  (SELECT max(page) FROM g WHERE g.document_id = v.document_id AND text_start < document_end AND text_end > document_start) AS hi FROM v LEFT JOIN s USING (segment_id) LEFT JOIN d ON d.document_id = v.document_id)
SELECT type, id FROM (SELECT id, CASE WHEN status NOT IN ('RESOLVED', 'VERIFIED') THEN 'UNRESOLVED_EVIDENCE' WHEN st IS NOT NULL AND NOT coalesce(substr(st, segment_start + 1, segment_end - segment_start) = evidence, false) THEN 'INVALID_SEGMENT_EVIDENCE'
  WHEN NOT coalesce(substr(dt, document_start + 1, document_end - document_start) = evidence, false) THEN 'INVALID_DOCUMENT_EVIDENCE' WHEN n > 0 AND NOT coalesce(page_start = lo AND page_end = hi, false) THEN 'INVALID_PAGE_EVIDENCE' END AS type FROM a) WHERE type IS NOT NULL"""


@query(_EVIDENCE_SQL)
def q_evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG3: stored spans cut out again of their segment, their document and its pages."""
    t = lambda c, r: frame(spark, c, r)
    return A.evidence_issues(t(_EVD, _EVD_ROWS), t(_SEG, _SEG_ROWS), t(_SRC, _SRC_ROWS), t(_PAG, _PAG_ROWS))


_CHG = "change_id string, operation string, review_status string, effective_from string, target_identity string, exclusion_reason string"
_CHG_ROWS = [
    ("k1", "AMEND", "APPROVED", "2021-01-01", "i1", None),
    ("k2", "REPEAL", "APPROVED", "2021-01-01", "i2", None),
    ("k3", "REPLACE", "APPROVED", "2022-01-01", "i3", None),
    ("k4", "AMEND", "APPROVED", None, "i1", None),
    ("k5", "AMEND", "EXCLUDED", None, None, "other law"),
    ("k6", "AMEND", "EXCLUDED", None, None, ""),
    ("k7", "REFERENCE", None, None, None, None),
]
_VER = "identity_id string, valid_from string, valid_to string, introduced_by string, ended_by string, verified boolean"
_VER_ROWS = [("i1", "2020-01-01", "2021-01-01", None, "k1", True), ("i1", "2021-01-01", None, "k1", None, True), ("i2", "2020-01-01", "2021-01-01", None, "k2", None), ("i3", "2020-01-01", "2022-01-01", None, "k3", True)]
_HED = "id string, provenance_status string"
_HED_ROWS = [("h1", "RESOLVED"), ("h2", None)]
_BLD = "build_id string, loaded_id string, load_passed boolean"
_BLD_ROWS = [("b1", "b1", True)]


@query(f"""WITH {cte("c", _CHG, _CHG_ROWS)}, {cte("r", _VER, _VER_ROWS)}, {cte("h", _HED, _HED_ROWS)}, {cte("b", _BLD, _BLD_ROWS)},
t AS (SELECT *, coalesce(review_status = 'APPROVED' AND effective_from <> '' AND target_identity <> '', false) AS ok, coalesce(review_status = 'EXCLUDED' AND exclusion_reason <> '', false) AS off FROM c WHERE operation IN ('AMEND', 'REPEAL', 'REPLACE')),
o AS (SELECT 'exact_evidence' AS "check", (SELECT count(*) FROM ({_EVIDENCE_SQL})) AS observed UNION ALL SELECT 'reviewed_temporal_changes', count(*) FROM t WHERE NOT ok AND NOT off
UNION ALL SELECT 'changes_applied_to_versions', count(*) FROM t WHERE ok AND (NOT EXISTS (SELECT 1 FROM r WHERE identity_id = target_identity AND ended_by = change_id AND valid_to = effective_from)
  OR operation <> 'REPEAL' AND NOT EXISTS (SELECT 1 FROM r WHERE identity_id = target_identity AND introduced_by = change_id AND valid_from = effective_from))
UNION ALL SELECT 'reviewed_provision_intervals', count(*) FROM r WHERE NOT coalesce(verified, false) UNION ALL SELECT 'hierarchy_provenance', count(*) FROM h WHERE provenance_status IS DISTINCT FROM 'RESOLVED'
UNION ALL SELECT 'current_graph_build', count(*) FROM b WHERE NOT (load_passed AND loaded_id = build_id)) SELECT "check", observed, observed = 0 AS passed FROM o""")
def q_readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG4, QG7: the six checks before a build may be used."""
    t = lambda c, r: frame(spark, c, r)
    return A.readiness(q_evidence_issues(spark, sf_dir), t(_CHG, _CHG_ROWS), t(_VER, _VER_ROWS), t(_HED, _HED_ROWS), t(_BLD, _BLD_ROWS))
