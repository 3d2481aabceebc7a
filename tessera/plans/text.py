"""Queries over text functions and the law grammar: driver documents, and inline rows where those lack the shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import legal as G
from tessera.functions import text as X
from tessera.operators import questions as Q
from tessera.plans.inline import cte, frame
from tessera.plans.registry import query
from tessera.session import table

_NOISY = "id int, text string"
_NOISY_ROWS = [(1, "Trang 3/10\nĐiều 1.  Phạm vi\t áp dụng\n\n\n\n12\nNội dung"), (2, "page 2 of 9\r\n  a) một \n  b) hai  "), (3, ""), (4, "12.5\n13\n\n  \nPage 4\nend"), (5, "﻿x​y  z")]


def _clean_sql(source: str) -> str:
    c = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\t\x{{00A0}} ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    lines = c("ln")
    return rf"""SELECT id, {c("string_agg(l, chr(10) ORDER BY i)")} AS clean FROM (SELECT id, i, {lines} AS l FROM (
      SELECT id, unnest(string_split(u, chr(10))) AS ln, generate_subscripts(string_split(u, chr(10)), 1) AS i FROM (
      SELECT id, regexp_replace(regexp_replace(text, '[\x{{FEFF}}\x{{200B}}]', '', 'g'), '\r\n?', chr(10), 'g') AS u FROM {source})))
    WHERE NOT (regexp_matches(l, '^\s*Trang\s+\d+(\s*/\s*\d+)?\s*$', 'i') OR regexp_matches(l, '^\s*Page\s+\d+(\s+of\s+\d+)?\s*$', 'i') OR regexp_matches(l, '^\s*\d+\s*$')) GROUP BY id"""


@query(f"WITH {cte('noisy', _NOISY, _NOISY_ROWS)}, src AS (SELECT id, text FROM noisy UNION ALL SELECT 1000 + doc_id, text FROM documents) {_clean_sql('src')}")
def q_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN2, FN3: page furniture removed and white space collapsed."""
    docs = table(spark, sf_dir, "documents").select((1000 + F.col("doc_id")).alias("id"), "text")
    rows = frame(spark, _NOISY, _NOISY_ROWS).select(F.col("id").cast("long").alias("id"), "text").unionByName(docs)
    return rows.select("id", X.clean_lines(F.col("text")).alias("clean"))


@query("""SELECT doc_id, 'doc_' || substr(sha1(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || CASE WHEN n_chars = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END), 1, 16) AS id FROM documents""")
def q_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4: hashed identifiers in which null, empty and zero parts are alike."""
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id("doc", F.col("source"), F.col("lang"), F.col("n_chars")).alias("id"))


@query("""WITH p AS (SELECT source, doc_id, text, count(*) OVER (PARTITION BY source) AS n FROM documents),
l AS (SELECT source, doc_id, n, line FROM (SELECT source, doc_id, n, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line) <> '' AND length(line) <= 120)
SELECT source, line, count(DISTINCT doc_id) AS pages FROM l GROUP BY source, line, n HAVING n >= 3 AND count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) >= least(3, greatest(2, CAST(floor(n * 0.55 + 0.999) AS INTEGER)))""")
def q_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: short lines on at least three pages (fewer where 55 % of a source's pages are fewer), pages being documents."""
    docs = table(spark, sf_dir, "documents")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    lines = docs.select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter((F.trim("line") != "") & (F.length("line") <= 120))
    counted = lines.groupBy("source", "line").agg(F.count("*").alias("pages")).join(n, "source")
    cutoff = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("n") * 0.55 + 0.999)))
    return counted.filter((F.col("n") >= 3) & (F.col("pages") >= cutoff)).select("source", "line", "pages")


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0)) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0))) AS n_terms FROM documents""")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16: tokens and distinct terms of every document."""
    words = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


_PATHS = "relative_path string"
_PATH_ROWS = [("data/Laws/45-2019-QH14.pdf",), ("data/decrees/145-2020-NĐ-CP_a.docx",), ("x/circulars/10_2020_TT-BLDTBXH.html",), ("x/consolidated/9.pdf",), ("x/judgments/02-2025-LĐPT.pdf",), ("x/ilo/c87.txt",), ("readme.json",), ("a/resolutions/05-2018-NQ-HDTP.pdf",), ("a/official_guidance/q.htm",), ("data/laws/a.PPTX",)]


@query(f"""WITH {cte("p", _PATHS, _PATH_ROWS)}, l AS (SELECT relative_path, lower(relative_path) AS s, upper(replace(relative_path, 'Đ', 'D')) AS u FROM p WHERE regexp_matches(lower(relative_path), '\\.(pdf|doc|docx|html|htm|txt|json)$'))
SELECT relative_path, CASE WHEN contains(s, '/laws/') OR contains(s, '/decrees/') OR contains(s, '/circulars/') OR contains(s, '/resolutions/') THEN 'LEGAL_DOCUMENT' WHEN contains(s, '/consolidated/') THEN 'CONSOLIDATED'
  WHEN contains(s, '/judgments/') THEN 'JUDICIAL' WHEN contains(s, '/official_guidance/') OR contains(s, '/ilo/') THEN 'SUPPLEMENTARY' ELSE 'UNKNOWN' END AS source_group,
  contains(s, '/laws/') OR contains(s, '/decrees/') OR contains(s, '/circulars/') OR contains(s, '/resolutions/') AS binding_default,
  CASE WHEN regexp_matches(u, '(^|[^0-9])[0-9]{{1,4}}[-_][0-9]{{4}}[-_]QH[0-9]+($|[-_ (.])') THEN regexp_replace(regexp_extract(u, '[0-9]{{1,4}}[-_][0-9]{{4}}[-_]QH[0-9]+'), '[-_]', '/', 'g')
    WHEN regexp_matches(u, '[-_]ND[-_]CP($|[-_ (.])') THEN regexp_replace(regexp_extract(u, '[0-9]{{1,4}}[-_][0-9]{{4}}'), '[-_]', '/', 'g') || '/NĐ-CP'
    WHEN regexp_matches(u, '[-_]TT[-_]BLDTBXH') THEN regexp_replace(regexp_extract(u, '[0-9]{{1,4}}[-_][0-9]{{4}}'), '[-_]', '/', 'g') || '/TT-BLĐTBXH'
    WHEN regexp_matches(u, '[-_]NQ[-_]HDTP') THEN regexp_replace(regexp_extract(u, '[0-9]{{1,4}}[-_][0-9]{{4}}'), '[-_]', '/', 'g') || '/NQ-HĐTP' END AS number FROM l""")
def q_manifest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2, FN5: supported files, their group and binding flag, and the number their names spell."""
    path = F.col("relative_path")
    rows = frame(spark, _PATHS, _PATH_ROWS).filter(F.lower(path).rlike(r"\.(pdf|doc|docx|html|htm|txt|json)$"))
    group, _, binding = G.classify_path(path)
    return rows.select(path, group.alias("source_group"), binding.alias("binding_default"), G.number_from_file(path).alias("number"))


_LAW = "id int, text string"
_LAW_ROWS = [
    (1, "Bộ luật này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2021. Trợ cấp 1.500.000 đồng và 30 % lương."),
    (2, "Luật này có hiệu lực từ ngày 1/7/2024. Nghị định này có hiệu lực kể từ ngày 15/8/2024."),
    (3, "Nghị định này có biệu lực từ ngày 30/11/2025."),
    (4, "Thông tư này có hiệu lực từ ngày 31/2/2020."),
    (5, "Theo điểm b khoản 2 Điều 35 Bộ luật 45/2019/QH14 và điều 12, khoản 1 điều 3. Người lao động phải báo trước."),
    (6, "Trừ trường hợp luật quy định khác, không được sa thải; người lao động được nghỉ hằng năm."),
    (7, "plain text without any of it, 12,5 % only and 20 000 000 VNĐ"),
]


@query(f"""WITH {cte("t", _LAW, _LAW_ROWS)} SELECT id, CASE id WHEN 1 THEN DATE '2021-01-01' WHEN 3 THEN DATE '2025-11-30' END AS effective_from,
array_to_string(list_transform(regexp_extract_all(text, '([0-9][0-9. ]{{2,}})\\s*(?:đồng|VNĐ)', 1), lambda x: trim(x)), ';') AS money,
array_to_string(regexp_extract_all(text, '\\b([0-9]{{1,3}}(?:[,.][0-9]+)?)\\s*%', 1), ';') AS percents FROM t""")
def q_dates_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN9, FN10, FN11, AG4: the only effective date (repaired spellings, calendar-checked), amounts and percentages."""
    t = F.col("text")
    return frame(spark, _LAW, _LAW_ROWS).select("id", G.effective_date(t).alias("effective_from"), F.array_join(G.money(t), ";").alias("money"), F.array_join(G.percents(t), ";").alias("percents"))


@query(f"""WITH {cte("t", _LAW, _LAW_ROWS)}, r AS (SELECT id, unnest(regexp_extract_all(text, '(?i)(?:điểm\\s*[a-zđ]\\s*)?(?:khoản\\s*[0-9]+[a-z]?\\s*)?điều\\s*[0-9]+[a-z]?(?:\\s+(?:của\\s+)?(?:(?:nghị\\s+định|thông\\s+tư|bộ\\s+luật|luật)\\s*(?:số\\s*)?)?[0-9]{{1,4}}/[0-9]{{4}}/[A-ZĐ0-9-]+)?')) AS m FROM t)
SELECT id, nullif(regexp_extract(m, '(?i)điểm\\s*([a-zđ])', 1), '') AS point, nullif(regexp_extract(m, '(?i)khoản\\s*([0-9]+[a-z]?)', 1), '') AS clause,
  regexp_extract(m, '(?i)điều\\s*([0-9]+[a-z]?)', 1) AS article, nullif(regexp_extract(m, '[0-9]{{1,4}}/[0-9]{{4}}/[A-ZĐ0-9-]+'), '') AS instrument FROM r""")
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17: references with point, clause, article and instrument."""
    return frame(spark, _LAW, _LAW_ROWS).select("id", F.explode(G.references(F.col("text"))).alias("r")).select("id", "r.point", "r.clause", "r.article", "r.instrument")


@query(f"""WITH {cte("t", _LAW, _LAW_ROWS)}, s AS (SELECT id, lower(text) AS low FROM t)
SELECT id, CASE WHEN contains(low, 'trừ trường hợp') OR contains(low, 'ngoại trừ') OR contains(low, 'không áp dụng') THEN 'EXCEPTION' WHEN contains(low, 'không được') OR contains(low, 'nghiêm cấm') THEN 'PROHIBITION'
  WHEN contains(low, 'phải ') OR contains(low, 'có trách nhiệm') OR contains(low, 'có nghĩa vụ') THEN 'REQUIRED' WHEN contains(low, 'nếu ') OR contains(low, 'khi ') OR contains(low, 'trường hợp') OR contains(low, 'với điều kiện') THEN 'CONDITION'
  WHEN contains(low, 'được ') OR contains(low, 'có quyền') THEN 'PERMISSION' WHEN contains(low, 'trong thời hạn') OR contains(low, 'chậm nhất') OR contains(low, 'trước ít nhất') OR contains(low, 'ngày làm việc') THEN 'DEADLINE' END AS trigger,
  CAST(contains(low, 'chấm dứt') AS INTEGER) + CAST(contains(low, 'sa thải') AS INTEGER) + CAST(contains(low, 'thôi việc') AS INTEGER) + CAST(contains(low, 'cho tôi nghỉ') AS INTEGER) + CAST(contains(low, 'cho nghỉ việc') AS INTEGER) + CAST(contains(low, 'buộc nghỉ') AS INTEGER) + CAST(contains(low, 'đơn phương') AS INTEGER) AS termination_hits,
  CAST(contains(low, 'nghỉ hằng năm') AS INTEGER) + CAST(contains(low, 'nghỉ hàng năm') AS INTEGER) + CAST(contains(low, 'nghỉ phép') AS INTEGER) + CAST(contains(low, 'phép năm') AS INTEGER) AS leave_hits FROM s""")
def q_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14, FN15: the first trigger kind and keyword hits per issue."""
    t = F.col("text")
    return frame(spark, _LAW, _LAW_ROWS).select("id", X.first_hit(t, G.TRIGGERS).alias("trigger"), X.hits(t, G.ISSUES["TERMINATION"]).alias("termination_hits"), X.hits(t, G.ISSUES["LEAVE"]).alias("leave_hits"))


#: English keywords for the driver's documents.
_TOPICS = {"INSULT": ["idiot", "stupid", "moron"], "RULE": ["the ", "and "], "NUMBER": ["0", "1"]}


@query("""WITH s AS (SELECT doc_id, lower(text) AS low FROM documents), h AS (
SELECT doc_id, 'INSULT' AS issue, CAST(contains(low, 'idiot') AS INTEGER) + CAST(contains(low, 'stupid') AS INTEGER) + CAST(contains(low, 'moron') AS INTEGER) AS hits FROM s
UNION ALL SELECT doc_id, 'RULE', CAST(contains(low, 'the ') AS INTEGER) + CAST(contains(low, 'and ') AS INTEGER) FROM s UNION ALL SELECT doc_id, 'NUMBER', CAST(contains(low, '0') AS INTEGER) + CAST(contains(low, '1') AS INTEGER) FROM s)
SELECT doc_id, issue, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, issue) AS INTEGER) AS rank FROM h WHERE hits >= 1""")
def q_issue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN15, TK1: substring hits per issue over the documents, most hits first; ranks are made within the row."""
    t = F.col("text")
    scored = F.array(*[F.struct((-X.hits(t, words)).alias("minus"), F.lit(name).alias("issue")) for name, words in _TOPICS.items()])
    ordered = F.array_sort(F.filter(scored, lambda x: x["minus"] < 0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ordered).alias("pos", "x"))
    return rows.select("doc_id", "x.issue", (-F.col("x.minus")).alias("hits"), (F.col("pos") + 1).alias("rank"))


_ASKED = "qid int, question string"
_ASKED_ROWS = [
    (1, "Điều 1 nghị định 145/2020/NĐ-CP quy định gì?"),
    (2, "Nghỉ  hằng năm được bao nhiêu ngày vào 2025-03-01?"),
    (3, "Công ty cho tôi nghỉ việc tháng 6/2020, báo trước 10 ngày, có đúng luật không?"),
    (4, "Sa thải như vậy có được không?"),
    (5, "So sánh tiền lương hiện nay và bảo hiểm xã hội"),
    (6, "Tìm bản án về tranh chấp 05/06/2019"),
    (7, "xin chào"),
]
_ANALYSED = [
    (1, "GENERAL", None, "NONE", "LOOKUP", "NONE", "DIRECT", 0, "governing_rule,official_source"),
    (2, "LEAVE", "2025-03-01", "DAY", "EXPLAIN", "HISTORICAL", "STANDARD", 0, "governing_rule,official_source,applicable_version,conditions,exceptions"),
    (3, "TERMINATION", "2020-06-01", "MONTH", "ASSESS_LEGALITY", "HISTORICAL", "COMPLEX", 2, "governing_rule,official_source,applicable_version,termination_conditions,notice_requirement,exceptions,mandatory_reference"),
    (4, "TERMINATION", None, "NONE", "ASSESS_LEGALITY", "NONE", "STANDARD", 4, "governing_rule,official_source,termination_conditions,notice_requirement,exceptions"),
    (5, "WAGE,SOCIAL_INSURANCE", None, "NONE", "COMPARE", "CURRENT", "COMPLEX", 0, "governing_rule,official_source,applicable_version,mandatory_reference"),
    (6, "DISPUTE", "2019-06-05", "DAY", "FIND_CASE", "HISTORICAL", "STANDARD", 0, "governing_rule,official_source,applicable_version"),
    (7, "GENERAL", None, "NONE", "EXPLAIN", "NONE", "STANDARD", 0, "governing_rule,official_source"),
]


@query()
def q_query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18, FN22, FN23, FN24: analysis and evidence plan of a table of questions (expected rows are pinned in tests)."""
    rows = Q.analyze(Q.intake(frame(spark, _ASKED, _ASKED_ROWS)), as_of="2026-01-01")
    slots = F.array_join(Q.mandatory_slots(), ",").alias("slots")
    return rows.select("qid", F.array_join("issues", ",").alias("issues"), "query_date", "precision", "outcome", "temporal_intent", "route", F.size("missing_facts").alias("n_missing"), slots)


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\n+'), lambda s: trim(s) <> '')) AS INTEGER) AS n_lines FROM documents""")
def q_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13: non-empty lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\n+"), lambda s: F.trim(s) != "")).alias("n_lines"))


@query()
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13: sentences of every document (cut by lookbehind, which the oracle's expressions lack)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@query("""WITH v AS (SELECT * FROM (VALUES ('2024-1-1'), ('2024-02-30'), ('2024-02-29'), ('20240101'), (NULL), ('2020-12-31')) t(v))
SELECT v, CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(v AS DATE) END AS day FROM v""")
def q_strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16: dates only of the exact shape that exist in the calendar."""
    rows = frame(spark, "v string", [("2024-1-1",), ("2024-02-30",), ("2024-02-29",), ("20240101",), (None,), ("2020-12-31",)])
    return rows.select("v", X.strict_date(F.col("v")).alias("day"))
