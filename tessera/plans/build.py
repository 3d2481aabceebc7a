"""Corpus-building, export and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import gates as Q
from tessera.operators import resolver as V
from tessera.operators import structure as S
from tessera.operators.graph import with_both_ends
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import sinks
from tessera.sources.files import pending
from tessera.sources.graph_store import load_graph, read_graph
from tessera.sources.scratch import scratch_path

DOCS = [
    ("laws/45-2019-QH14.pdf", "LEGAL_DOCUMENT", "LAW", "QUỐC HỘI\nBỘ LUẬT\nLAO ĐỘNG\nCăn cứ Hiến pháp\nĐiều 35. Quyền chấm dứt hợp đồng\n1. Người lao động có quyền đơn phương chấm dứt\na) Không được trả đủ lương đúng hạn\nĐiều 36. Theo khoản 1 Điều 35 thì báo trước\nBộ luật này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2021."),
    ("decrees/145-2020-NĐ-CP.docx", "LEGAL_DOCUMENT", "DECREE", "CHÍNH PHỦ\nNGHỊ ĐỊNH\nQuy định chi tiết\nĐiều 1. Nghị định này quy định chi tiết điểm a khoản 1 Điều 35 Bộ luật 45/2019/QH14\nĐiều 2. Sửa đổi Điều 36 Bộ luật Lao động như sau"),
    ("judgments/02-2025-LĐPT.pdf", "JUDICIAL", "JUDGMENT", "TÒA ÁN\nNội dung vụ án: bị đơn sa thải theo Điều 35 Bộ luật 45/2019/QH14.\nNhận định của Tòa án: có căn cứ.\nQuyết định: chấp nhận."),
]


def _registry(spark: SparkSession) -> DataFrame:
    rows = [(f"file{i}", p, p.split("/")[-1], t, f"sha{i}", g, k) for i, (p, g, k, t) in enumerate(DOCS)]
    docs = frame(spark, "file_id string, relative_path string, filename string, text string, sha256 string, source_group string, document_type_hint string", rows)
    return C.registry(docs, frame(spark, "relative_path string, issuer string", [("judgments/02-2025-LĐPT.pdf", "TAND")]))


@query()
def q_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, FN5 to FN8, TK9, PF10: registry records (expected rows are pinned in tests)."""
    return _registry(spark).select("relative_path", "document_number", "case_number", "effective_from", "title", "issuer", "instrument_type", "authority_rank", "instrument_id")


@query()
def q_case_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12: sections of judgments (expected rows are pinned in tests)."""
    rows = _registry(spark).filter("source_group = 'JUDICIAL'")
    return rows.select("case_number", *[c.alias(k) for k, c in C.case_sections(F.col("text")).items()])


def _provisions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    docs = _registry(spark)
    return docs, S.provisions(docs.filter("source_group = 'LEGAL_DOCUMENT'").select("document_id", "text"))


def _citations(spark: SparkSession) -> DataFrame:
    docs, rows = _provisions(spark)
    cases = docs.filter("source_group = 'JUDICIAL'").select(F.col("document_id").alias("source_id"), F.lit(None).cast("string").alias("owner"), "text")
    sources = rows.select(F.col("provision_id").alias("source_id"), F.col("document_id").alias("owner"), F.regexp_replace("text", r"^Điều \d+\. ", "").alias("text")).unionByName(cases)
    alias = docs.filter("document_number = '45/2019/QH14'").select(F.lit("Bộ luật Lao động").alias("alias"), "document_id")
    return C.citations(sources, docs.select("document_id", "document_number", "authority_rank"), rows, alias)


@query()
def q_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, FN17, JN5, JN6, JN7: citations and relation edges (expected rows are pinned in tests)."""
    _, rows = _provisions(spark)
    paths = rows.select(F.col("provision_id").alias("target_id"), F.concat_ws("/", "article_number", F.when(F.col("clause_number") != "", F.col("clause_number")), F.when(F.col("point_number") != "", F.col("point_number"))).alias("target"))
    return C.relation_edges(_citations(spark)).join(paths, "target_id").select("type", "target", "confidence", "edge_id")


@query()
def q_retrieval_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR1, TK6, PF2: retrieval units with breadcrumbs and ancestors (expected rows are pinned in tests)."""
    docs, rows = _provisions(spark)
    return C.retrieval_units(rows, docs).select("unit_id", "breadcrumb", "ancestor_context", "source_text", "document_number")


@query("""SELECT CASE WHEN role = 'user' THEN 'accepted' ELSE 'review' END AS queue, count(*) AS n FROM conversations GROUP BY 1""")
def q_status_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9: accepted rows and the rest, unknown ones among the rest."""
    accepted = F.col("role").eqNullSafe("user")
    return table(spark, sf_dir, "conversations").groupBy(F.when(accepted, "accepted").otherwise("review").alias("queue")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS kind, coalesce(p_size, 0) > 25 AS large, p_brand || '/' || p_size AS path FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') OR length(trim(p_name)) >= 10""")
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF1, PF7, PF8: projection with casts, membership and minimum length."""
    rows = table(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#11", "Brand#12") | (F.length(F.trim("p_name")) >= 10))
    return rows.select("p_partkey", F.concat(F.upper(F.substring("p_type", 1, 1)), F.expr("substring(p_type, 2)")).alias("kind"), (F.coalesce("p_size", F.lit(0)) > 25).alias("large"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"))


_CODES = "code string, kind string, http int"
_CODE_ROWS = [("SHA_MISMATCH", "timeout", None), ("HTTP_404", "http", 404), ("HTTP_999", "decode", None), ("ODD", "other", None)]


@query(f"""WITH {cte("t", _CODES, _CODE_ROWS)} SELECT code, code IN ('SHA_MISMATCH', 'IDENTITY_MISMATCH', 'AUTHORITY_MISMATCH', 'UNKNOWN_MAGIC', 'MIME_MISMATCH', 'TOO_LARGE', 'NETWORK_ERROR', 'FETCH_ERROR', 'ENCODING_ERROR') OR regexp_full_match(code, 'HTTP_[1-5][0-9][0-9]') AS known,
CASE WHEN http IS NOT NULL THEN 'HTTP_' || http WHEN kind IN ('timeout', 'connection', 'dns') THEN 'NETWORK_ERROR' WHEN kind = 'decode' THEN 'ENCODING_ERROR' ELSE 'FETCH_ERROR' END AS reason FROM t""")
def q_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF15, FN30: known reason codes, and the code of a failed fetch."""
    return frame(spark, _CODES, _CODE_ROWS).select("code", C.reason_known(F.col("code"), V.KNOWN_REASONS).alias("known"), C.reason_from_error(F.col("kind"), F.col("http")).alias("reason"))


@query("""WITH v AS (SELECT o_custkey AS identity, CAST(o_orderdate AS DATE) AS valid_from, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS valid_to FROM orders),
c AS (SELECT o_orderkey AS change_id, CASE WHEN o_orderstatus = 'F' THEN 'REPEAL' ELSE 'AMEND' END AS kind, o_custkey AS identity, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT change_id, EXISTS (SELECT 1 FROM v WHERE v.identity = c.identity AND v.valid_to = c.date) AND (kind = 'REPEAL' OR EXISTS (SELECT 1 FROM v WHERE v.identity = c.identity AND v.valid_from = c.date)) AS ok FROM c""")
def q_change_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: reviewed changes against the versions they end and start."""
    from tessera.operators.temporal import intervals_from_events

    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    versions = intervals_from_events(orders.select(F.col("o_custkey").alias("identity"), "o_orderkey", "day"), ["identity"], ["day", "o_orderkey"], "day")
    changes = orders.select(F.col("o_orderkey").alias("change_id"), F.when(F.col("o_orderstatus") == "F", "REPEAL").otherwise("AMEND").alias("kind"), F.col("o_custkey").alias("identity"), F.col("day").alias("date"))
    return C.change_problems(changes, versions).select("change_id", "ok")


@query("""SELECT source, array_to_string(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(langs, x)), ',') AS lacking FROM (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY source)""")
def q_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, SE4: what is required and wasn't observed."""
    need = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it")])
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_except(need, F.collect_set("lang")), ",").alias("lacking"))


@query("""WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
u AS (SELECT source, doc_id, min(CASE WHEN ch = 0 THEN k ELSE 100 + k END) AS pos FROM (SELECT source, doc_id, k, 0 AS ch FROM a WHERE k <= 5 UNION ALL SELECT source, doc_id, k, 1 FROM b WHERE k <= 5) GROUP BY source, doc_id)
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM u GROUP BY source""")
def q_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE2: two ranked lists joined, first occurrence kept."""
    from tessera.operators.retrieval import top_per

    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    listed = lambda order: F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(order)
    a = top_per(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).groupBy("source").agg(listed("a"))
    b = top_per(docs, ["source"], [F.col("doc_id")], 5).groupBy("source").agg(listed("b"))
    return a.join(b, "source").select("source", F.array_join(F.array_distinct(F.concat("a", "b")), ",").alias("ids"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, len(embedding) AS dim, greatest(0, least(100, label * 15)) AS clipped,
abs(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 1) < 1e-3 AS unit FROM embeddings""")
def q_dense_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR2, FN29: norms, dimensions and self products of stored vectors."""
    square = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(square), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"), F.greatest(F.lit(0), F.least(F.lit(100), F.col("label") * 15)).alias("clipped"), (F.abs(square - 1) < 1e-3).alias("unit"))


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: what a resumed run still has to do."""
    return pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


_OVER = "record_id string, role string, url string"
_OVER_ROWS = [("r1", "BINARY", "https://a/1"), ("", "IDENTITY", "http://a/2"), ("r3", "OTHER", None)]


@query(f"""WITH {cte("t", _OVER, _OVER_ROWS)} SELECT role, concat_ws(',', CASE WHEN role NOT IN ('IDENTITY', 'BINARY', 'STATUS') THEN 'BAD_ROLE' END, CASE WHEN NOT coalesce(starts_with(url, 'https://'), false) THEN 'NOT_HTTPS' END, CASE WHEN record_id = '' THEN 'NO_RECORD' END) AS problems FROM t""")
def q_override_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV4, PF3: what is wrong with overrides."""
    rows = frame(spark, _OVER, _OVER_ROWS)
    return rows.select("role", F.array_join(C.override_problems({c: F.col(c) for c in rows.columns}, ("IDENTITY", "BINARY", "STATUS")), ",").alias("problems"))


_FILE = "id int, kind string, reasons array<string>, authority_ok boolean"
_FILE_ROWS = [(1, "PDF", [], True), (2, None, ["UNKNOWN_MAGIC"], True), (3, "PDF", ["SHA_MISMATCH"], True), (4, "ZIP", ["MIME_MISMATCH"], True), (5, "PDF", [], False)]


@query(f"""WITH {cte("t", _FILE, _FILE_ROWS)} SELECT id, kind IS NOT NULL AND NOT list_has_any(reasons, ['UNKNOWN_MAGIC', 'MIME_MISMATCH', 'TOO_LARGE']) AND authority_ok AS trusted FROM t""")
def q_binary_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV7: whether a fetched file can be trusted."""
    return frame(spark, _FILE, _FILE_ROWS).select("id", V.trusted(F.col("kind"), F.col("reasons"), F.col("authority_ok")).alias("trusted"))


@query("""SELECT c_mktsegment AS provider, o_orderstatus AS state, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS reasons
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL""")
def q_resolution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV8, RV10, AG1: distributions over provider, state and reasons of selected records."""
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("provider"), F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("reasons"))


@query("""WITH o AS (SELECT 'orders_have_customers' AS gate, count(*) FILTER (c_custkey IS NULL) AS observed FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'lines_have_orders', count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'unique_documents', count(*) - count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'labels_binary', count(*) FILTER (toxic NOT IN (0, 1) OR quality NOT IN (0, 1)) FROM labels) SELECT gate, observed, CAST(0 AS BIGINT) AS expected, observed = 0 AS passed FROM o""")
def q_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: observed against expected, gate by gate."""
    t = lambda n: table(spark, sf_dir, n)
    orphans = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    gates = {
        "orders_have_customers": orphans.agg(F.count("*").alias("observed")),
        "lines_have_orders": lines.agg(F.count("*").alias("observed")),
        "unique_documents": t("documents").agg((F.count("*") - F.count_distinct("doc_id")).alias("observed")),
        "labels_binary": t("labels").agg(F.count_if(~F.col("toxic").isin(0, 1) | ~F.col("quality").isin(0, 1)).alias("observed")),
    }
    rows = Q.together([df.select(F.lit(name).alias("gate"), "observed") for name, df in gates.items()])
    return rows.select("gate", "observed", F.lit(0).cast("long").alias("expected"), (F.col("observed") == 0).alias("passed"))


@query("""SELECT page_id, coalesce(regexp_full_match(url, 'https?://[^/]+/?(?:home|index\\.html?)?'), false) OR contains(lower(substr(html, 1, 4000)), 'trang chủ') AS home FROM pages""")
def q_home_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV12: front pages among fetched pages."""
    return table(spark, sf_dir, "pages").select("page_id", C.home_page(F.col("url"), F.col("html")).alias("home"))


@query("""SELECT d.doc_id, b.item_id, substr(d.text, CAST(strpos(d.text, b.text) AS BIGINT), length(b.text)) = b.text AS exact, CAST(CEIL(strpos(d.text, b.text) / 1000.0) AS INTEGER) AS page FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def q_evidence_reverify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located passages cut out again, with the page they stand on (pages of 1000 characters)."""
    from tessera.plans.answer import q_evidence_locate

    spans = q_evidence_locate(spark, sf_dir).select("doc_id", "item_id")
    rows = spans.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")), "item_id")
    at = F.expr("instr(text, phrase)")
    return rows.select("doc_id", "item_id", (F.expr("substring(text, instr(text, phrase), length(phrase))") == F.col("phrase")).alias("exact"), F.ceil(at / 1000).cast("int").alias("page"))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS units_without_node, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS nodes_without_unit, count(*) FILTER (l.doc_id IS NULL) > 0 AS provisional FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG9: whether stored tables belong together."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    a = docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("units_without_node"))
    b = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("nodes_without_unit"))
    both = a.select(F.lit(1).alias("k"), "*").join(b.select(F.lit(1).alias("k"), "*"), "k")
    return both.select("units_without_node", "nodes_without_unit", (F.col("units_without_node") > 0).alias("provisional"))


_PAGES = "page int, action string, rotation int, sha string, expected string"
_PAGE_ROWS = [(1, "OCR", 0, "a", "a"), (2, "DROP", 90, "a", "a"), (3, "BLANK", 45, "b", "a")]


@query(f"""WITH {cte("t", _PAGES, _PAGE_ROWS)} SELECT page, concat_ws(',', CASE WHEN sha <> expected THEN 'STALE_SHA' END, CASE WHEN action NOT IN ('OCR', 'BLANK', 'ROTATE') THEN 'BAD_ACTION' END, CASE WHEN rotation NOT IN (0, 90, 180, 270) THEN 'BAD_ROTATION' END) AS problems FROM t""")
def q_page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG10: reviews of pages, bound to a digest."""
    from tessera.functions.text import missing

    c = F.col
    problems = missing({"STALE_SHA": c("sha") != c("expected"), "BAD_ACTION": ~c("action").isin("OCR", "BLANK", "ROTATE"), "BAD_ROTATION": ~c("rotation").isin(0, 90, 180, 270)})
    return frame(spark, _PAGES, _PAGE_ROWS).select("page", F.array_join(problems, ",").alias("problems"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'FIND_SOURCE' WHEN l.toxic = 1 THEN 'REJECT' WHEN l.quality = 1 THEN 'CONFIRM' ELSE 'REVIEW' END AS recommendation, CAST(NULL AS VARCHAR) AS reviewer, 'DRAFT' AS review_status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_review_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG16, QG18, SK11: review rows with a recommendation and empty review fields."""
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    advice = F.when(F.col("known").isNull(), "FIND_SOURCE").when(F.col("toxic") == 1, "REJECT").when(F.col("quality") == 1, "CONFIRM").otherwise("REVIEW")
    return rows.select("doc_id", advice.alias("recommendation"), F.lit(None).cast("string").alias("reviewer"), F.lit("DRAFT").alias("review_status"))


@query("""WITH m AS (SELECT l_orderkey, count(*) AS actual FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, max(l_linenumber) AS stated FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(stated, 0) AS stated, coalesce(actual, 0) AS actual FROM orders LEFT JOIN m ON m.l_orderkey = o_orderkey LEFT JOIN x ON x.l_orderkey = o_orderkey WHERE coalesce(stated, 0) <> coalesce(actual, 0)""")
def q_package_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG19: cases whose stated number of members isn't the actual one."""
    members = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("actual"), F.max("l_linenumber").alias("stated"))
    rows = table(spark, sf_dir, "orders").join(members, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select("o_orderkey", F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return rows.filter("stated <> actual")


@query("""SELECT n_nationkey, CAST(to_json({'name': n_name, 'region': n_regionkey}) AS VARCHAR) AS properties, coalesce(NULLIF(n_name, ''), 'UNKNOWN') AS label, 'vi' AS language FROM nation""")
def q_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2, SK4, SK8: nested columns as JSON, defaults filled."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("properties"), F.when(F.col("n_name") != "", F.col("n_name")).alias("label"))
    return sinks.flattened(sinks.with_defaults(rows, {"label": "UNKNOWN", "language": "vi"}, []))


@query("""SELECT s_suppkey, s_acctbal AS before, round(s_acctbal, 0) AS after FROM supplier WHERE s_acctbal IS DISTINCT FROM round(s_acctbal, 0)""")
def q_proposed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9: proposed values next to the present ones, never applied."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return sinks.differences(rows, rows.withColumn("s_acctbal", F.round("s_acctbal", 0)), ["s_suppkey"], "s_acctbal")


@query("""SELECT (SELECT count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) AS loaded, true AS equal""")
def q_load_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3, SE5: a load is exact if neither side has a row the other lacks."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("PART_OF").alias("type"))
    nodes = nation.select(F.col("source").alias("id")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
    loaded = with_both_ends(nation, nodes, "id")
    return loaded.agg(F.count("*").alias("loaded")).withColumn("equal", F.lit(sinks.verify_load(nation, loaded)))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations""")
def q_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6: the last question's turn carried forward."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return C.carried(rows, ["conv_id"], ["turn"], ["asked"]).select("conv_id", "turn", F.coalesce("asked", F.lit(-1)).alias("asked"))


@query("""SELECT kind, type, count(*) AS n, count(DISTINCT id) AS ids, min(properties) AS least FROM (
  SELECT 'node' AS kind, 'NATION' AS type, 'n' || n_nationkey AS id, n_name AS properties FROM nation UNION ALL SELECT 'node', 'REGION', 'r' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'node', 'SUPPLIER', 's' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'edge', 'PART_OF', 'n' || n_nationkey || '>r' || n_regionkey, NULL FROM nation UNION ALL SELECT 'edge', 'BELONGS_TO', 's' || s_suppkey || '>n' || s_nationkey, NULL FROM supplier) GROUP BY kind, type""")
def q_graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3: nodes and edges loaded into the graph store in one transaction, and read back."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    node = lambda df, kind, p, c, name: df.select(key(p, c).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("properties"))
    nodes = node(nation, "NATION", "n", "n_nationkey", "n_name").unionByName(node(region, "REGION", "r", "r_regionkey", "r_name")).unionByName(node(supplier, "SUPPLIER", "s", "s_suppkey", "s_name"))
    edge = lambda df, kind, a, b: df.select(F.concat(a, F.lit(">"), b).alias("id"), a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("properties"))
    edges = edge(nation, "PART_OF", key("n", "n_nationkey"), key("r", "n_regionkey")).unionByName(edge(supplier, "BELONGS_TO", key("s", "s_suppkey"), key("n", "s_nationkey")))
    path = scratch_path(spark, "graph-store")
    load_graph(spark, nodes, edges, path)
    return read_graph(spark, path).groupBy("kind", "type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("properties").alias("least"))
