"""Evidence and answer queries: located phrases, audits, coverage, states, compression, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import relational as L
from tessera.operators.patterns import phrase_matches
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query
from tessera.session import table


@query("""WITH pairs AS (SELECT DISTINCT d.doc_id, b.item_id, d.text, b.text AS phrase FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT doc_id, item_id, CAST((length(text) - length(replace(text, phrase, ''))) / length(phrase) AS INTEGER) AS n,
  CASE WHEN (length(text) - length(replace(text, phrase, ''))) / length(phrase) = 1 THEN strpos(text, phrase) - 1 END AS start FROM pairs""")
def q_evidence_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18, FN19: passages found in documents, with their position where there is one match."""
    found = E.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "item_id", "n", F.when(F.col("n") == 1, F.col("first")).alias("start"))


_PHRASE = "id int, text string, phrase string"
_PHRASE_ROWS = [(1, "Người lao  động có\nquyền nghỉ", "lao động có quyền"), (2, "a b a b", "a b"), (3, "x (1) y", "X (1)"), (4, "none", "other"), (5, "text", "")]


@query()
def q_phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18: phrases located with any white space between their words (expected rows are pinned in tests)."""
    found = E.locate(F.col("text"), F.col("phrase"))
    return frame(spark, _PHRASE, _PHRASE_ROWS).select("id", *[c.alias(n) for n, c in found.items()])


_ITEM = "unit_id string, kind string, unit_known boolean, node_known boolean, unit_url string, item_url string, catalog_known boolean, catalog_url string, catalog_status string, has_span boolean, char_start int, char_end int, structure_equal boolean, query_date string, provision_verified boolean, temporal_verified boolean, valid_from string, valid_to string"
_ITEM_ROWS = [
    ("u1", "PROVISION", True, True, "https://a", "https://a", True, "https://a", "VERIFIED", True, 0, 9, True, "2024-01-01", True, True, "2020-01-01", None),
    ("u2", "PROVISION", True, True, "https://a", "https://b", True, "https://a", "VERIFIED", False, None, None, True, None, False, False, None, None),
    ("u3", "CASE", False, False, None, None, False, None, None, False, None, None, False, "2024-01-01", False, True, "2020-01-01", "2023-01-01"),
    ("u4", "PROVISION", True, True, "https://c", "https://c", True, None, "UNVERIFIED", True, 9, 3, False, "2024-01-01", False, True, "2020-01-01", None),
    ("u5", "PROVISION", True, True, "https://c", "https://c", True, "https://c", "VERIFIED", True, 1, 3, True, "2024-01-01", False, False, "2020-01-01", None),
]


@query(f"""WITH {cte("t", _ITEM, _ITEM_ROWS)}, f AS (SELECT *, provision_verified OR temporal_verified AS usable, coalesce(valid_from <= query_date AND (valid_to IS NULL OR query_date < valid_to), false) AS holds FROM t)
SELECT unit_id, array_to_string(list_filter([CASE WHEN NOT unit_known THEN 'UNKNOWN_UNIT_ID' END, CASE WHEN NOT node_known THEN 'UNKNOWN_DOCUMENT_NODE' END,
  CASE WHEN unit_known AND item_url IS DISTINCT FROM unit_url THEN 'SOURCE_URL_NOT_FROM_UNIT' END, CASE WHEN NOT catalog_known THEN 'SOURCE_NOT_IN_CATALOG' END,
  CASE WHEN catalog_known AND catalog_url IS NOT NULL AND item_url IS DISTINCT FROM catalog_url THEN 'SOURCE_URL_NOT_FROM_CATALOG' END,
  CASE WHEN kind = 'PROVISION' AND NOT has_span THEN 'MISSING_SOURCE_SPAN' END, CASE WHEN char_end < char_start THEN 'INVALID_SOURCE_SPAN' END,
  CASE WHEN unit_known AND NOT structure_equal THEN 'GRAPH_STRUCTURE_MISMATCH' END, CASE WHEN query_date IS NOT NULL AND NOT usable THEN 'UNREVIEWED_PROVISION_INTERVAL' END,
  CASE WHEN query_date IS NOT NULL AND usable AND NOT holds THEN 'WRONG_VERSION' END], lambda x: x IS NOT NULL), ',') AS issues,
  array_to_string(list_filter([CASE WHEN catalog_known AND (catalog_url IS NULL OR item_url IS NOT DISTINCT FROM catalog_url) AND catalog_status IS DISTINCT FROM 'VERIFIED' THEN 'SOURCE_CATALOG_RECORD_UNVERIFIED' END,
  CASE WHEN query_date IS NOT NULL AND usable AND holds AND NOT provision_verified THEN 'DOCUMENT_LEVEL_TEMPORAL_FALLBACK' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f""")
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR16: deterministic audit of evidence."""
    return E.audit(frame(spark, _ITEM, _ITEM_ROWS)).select("unit_id", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"))


_ANSWER = "id int, answer string, verified_ids array<string>, cited_ids array<string>, claim string, claim_ids array<string>"
_ANSWER_ROWS = [
    (1, "See [prov_1] and [x + y].", ["prov_1"], ["prov_1"], "c1", ["prov_1"]),
    (2, "See [prov_2].", ["prov_1"], ["prov_2"], "c1", []),
    (3, "No markers (a) [1+1]", ["prov_1"], [], "c2", ["prov_9"]),
    (4, "[prov_1] [case_7]", ["prov_1", "case_7"], ["prov_1"], "c3", ["case_7"]),
]


@query(f"""WITH {cte("t", _ANSWER, _ANSWER_ROWS)}, m AS (SELECT *, list_filter(list_distinct(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1)), lambda x: list_contains(verified_ids, x) OR regexp_full_match(x, '(?i)(?:prov|case|diag|unit|article)[_ -][A-Za-z0-9_-]+')) AS m FROM t)
SELECT id, array_to_string(list_concat(list_concat(list_concat(CASE WHEN len(m) = 0 THEN ['ANSWER_HAS_NO_EVIDENCE_MARKERS'] ELSE [] END, list_sort(list_transform(list_filter(m, lambda x: NOT list_contains(verified_ids, x)), lambda x: 'UNSUPPORTED_CITATION:' || x))),
  list_concat(CASE WHEN len(list_filter(cited_ids, lambda x: NOT list_contains(verified_ids, x))) > 0 THEN ['CITATION_NOT_VERIFIED'] ELSE [] END, CASE WHEN len(list_filter(cited_ids, lambda x: NOT list_contains(m, x))) > 0 THEN ['CITATION_NOT_MARKED'] ELSE [] END)),
  list_concat(CASE WHEN len(claim_ids) = 0 THEN ['CLAIM_WITHOUT_EVIDENCE:' || claim] ELSE [] END, CASE WHEN len(list_filter(claim_ids, lambda x: NOT list_contains(verified_ids, x))) > 0 THEN ['CLAIM_UNSUPPORTED:' || claim] ELSE [] END)), ',') AS problems FROM m""")
def q_reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR17, SE7: citation markers against verified evidence and claims."""
    claims = F.array(F.struct(F.col("claim").alias("claim_id"), F.col("claim_ids").alias("evidence_ids")))
    rows = frame(spark, _ANSWER, _ANSWER_ROWS).withColumn("claims", claims)
    return E.reference_audit(rows).select("id", F.array_join("problems", ",").alias("problems"))


_SLOT = "q int, slot string, mandatory boolean, state string"
_SLOT_ROWS = [(1, "governing_rule", True, "FOUND_VERIFIED"), (1, "official_source", True, "FOUND"), (1, "case_law", False, "MISSING"), (2, "governing_rule", True, "MISSING"), (2, "exceptions", True, "FOUND"), (3, "governing_rule", True, "FOUND_VERIFIED"), (4, "case_law", False, "FOUND")]


@query(f"""WITH {cte("t", _SLOT, _SLOT_ROWS)}, c AS (SELECT q, coalesce(round(sum(CASE state WHEN 'FOUND_VERIFIED' THEN 1.0 WHEN 'FOUND' THEN 0.5 ELSE 0 END) FILTER (mandatory) / count(*) FILTER (mandatory), 6), 0.0)::DOUBLE AS coverage,
  coalesce(string_agg(slot, ',' ORDER BY slot) FILTER (mandatory AND state <> 'FOUND_VERIFIED'), '') AS gaps, count(*) FILTER (state = 'FOUND_VERIFIED') AS n FROM t GROUP BY q)
SELECT q, coverage, gaps, CASE WHEN n > 0 AND gaps = '' THEN 'SUFFICIENT' WHEN n > 0 AND coverage >= 0.5 THEN 'PARTIAL_ALLOWED' ELSE 'INSUFFICIENT_EVIDENCE' END AS state FROM c""")
def q_slots_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, SR18: coverage with half credit, gaps, and the answer's state."""
    slots = frame(spark, _SLOT, _SLOT_ROWS)
    n = slots.groupBy("q").agg(F.count_if(F.col("state") == "FOUND_VERIFIED").alias("n"))
    rows = E.coverage(slots, "q").join(n, "q")
    state = E.answer_state(F.lit(False), F.lit(0), F.col("n"), F.col("coverage"), F.size("gaps"))
    return rows.select("q", "coverage", F.array_join("gaps", ",").alias("gaps"), state.alias("state"))


@query()
def q_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK7, SR14: lines of every document that fit 700 characters, best first, in order (brute force in tests)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", E.compress(F.col("text"), F.concat_ws(" ", "lang", F.substring("text", 1, 200)), critical=("the ",)).alias("kept"))


@query("""SELECT doc_id, item_id FROM (SELECT d.doc_id, b.item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}_]{6,}', 0)), list_distinct(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]{6,}', 0)))) AS n FROM documents d, benchmark b) WHERE n >= 5""")
def q_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR15, FN16: documents that share at least five longer words with a passage."""
    from tessera.operators.retrieval import overlap_channel

    rows = overlap_channel(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", least=6)
    return rows.filter("overlap >= 5").select("doc_id", "item_id")


_CITE = "id string, point string, clause string, article string, number string, valid_from string, valid_to string"
_CITE_ROWS = [("a", "b", "2", "35", "45/2019/QH14", "2021-01-01", None), ("b", None, None, "1", "145/2020/NĐ-CP", "2020-01-01", "2022-01-01"), ("c", "", "1", "2", None, None, None)]


@query(f"""WITH {cte("t", _CITE, _CITE_ROWS)} SELECT id, printf('claim_%03d', CAST(row_number() OVER (ORDER BY id) AS INTEGER)) AS claim_id,
concat_ws(', ', CASE WHEN point <> '' THEN 'điểm ' || point END, CASE WHEN clause <> '' THEN 'khoản ' || clause END, CASE WHEN article <> '' THEN 'Điều ' || article END, number) AS place,
nullif(concat_ws(' → ', valid_from, valid_to), '') AS law_version FROM t""")
def q_citation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN31, WN3: numbered claims and citation texts from the parts that are there."""
    rows = L.numbered(frame(spark, _CITE, _CITE_ROWS), "id")
    version = F.concat_ws(" → ", "valid_from", "valid_to")
    claim = F.format_string("claim_%03d", F.col("position"))
    return rows.select("id", claim.alias("claim_id"), E.citation_text({k: F.col(k) for k in ("point", "clause", "article", "number")}).alias("place"), F.when(version != "", version).alias("law_version"))


@query("""SELECT d.doc_id, b.item_id, CAST((length(d.text) - length(replace(lower(d.text), lower(b.text), ''))) / length(b.text) AS BIGINT) AS n, CAST(instr(lower(d.text), lower(b.text)) - 1 AS INTEGER) AS first
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''""")
def q_phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7: every passage looked for in every text by one automaton."""
    hits = phrase_matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", whole_words=False, only_longest=False)
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("start").alias("first"))
