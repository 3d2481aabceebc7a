"""Hierarchical texts, alignment, located phrases and analysis against expected rows."""

from pyspark.sql import functions as F

from tessera.operators import alignment, evidence
from tessera.operators import structure as S
from tessera.plans import answer, documents, text


def read(spark, source, what=S.provisions):
    rows = what(spark.createDataFrame([("d", source)], "document_id string, text string"))
    return rows.orderBy("char_start" if "char_start" in rows.columns else "line_start", "level" if "level" in rows.columns else "line_end").collect()


def kinds(spark, source):
    return [(p["level"], p["number"]) for p in read(spark, source)]


def parts(spark, source):
    return [s["segment_type"] for s in read(spark, source, S.segments)]


LAW = documents.LAWS[0][1]


def test_law_with_annex_has_five_provisions(spark):
    assert kinds(spark, LAW) == [("ARTICLE", "35"), ("CLAUSE", "1"), ("CLAUSE", "2"), ("POINT", "a"), ("POINT", "b")]
    assert parts(spark, LAW) == ["PREAMBLE", "MAIN_BODY", "ANNEX"]


def test_spans_are_exact(spark):
    source = LAW.replace("2. Không", "\n   2. Không").replace("Điều 35", "\n  Điều 35")
    body = next(s["text"] for s in read(spark, source, S.segments) if s["segment_type"] == "MAIN_BODY")
    rows = read(spark, source)
    assert len(rows) == 5
    for p in rows:
        assert body[p["char_start"] : p["char_end"]] == p["text"]
    assert {p["chapter"] for p in rows} == {"I"}


def test_quoted_amendment_is_not_parsed(spark):
    assert kinds(spark, documents.LAWS[1][1]) == [("ARTICLE", "1"), ("CLAUSE", "1"), ("CLAUSE", "2"), ("ARTICLE", "2")]
    nested = "Điều 1. A\n1. Như sau:\n“1. Một “trong”\n2. Hai\nĐiều 7. B”\n2. Sau\n\"3) plain\n4. in\"\n3. out"
    assert kinds(spark, nested) == [("ARTICLE", "1"), ("CLAUSE", "1"), ("CLAUSE", "2"), ("CLAUSE", "3")]


def test_attached_regulation_needs_a_signature_before(spark):
    assert parts(spark, documents.LAWS[1][1]) == ["MAIN_BODY", "SIGNATURE", "ATTACHED_REGULATION"]
    assert parts(spark, "Điều 1. A\nQUY CHẾ") == ["MAIN_BODY"]
    assert parts(spark, "Điều 1. A\nNơi nhận: x\nTM. y\nQUY CHẾ\nQUY ĐỊNH\nMẫu số 1\nQUY ĐỊNH") == ["MAIN_BODY", "SIGNATURE", "ATTACHED_REGULATION", "FORM"]


def test_damaged_heading_and_prose(spark):
    lines = ["Đỉều 1l. Tên", "Dieu 2: x", "Điêu O7. y", "Khoản 3. z", "- a) m", "## Điều 4. t"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(S.repaired(F.col("line"))).collect()
    assert [r[0] for r in got] == ["Điều 11. Tên", "Điều 2: x", "Điều 07. y", "Khoản 3. z", "a) m", "Điều 4. t"]
    assert kinds(spark, "Điều 1. A\nĐiều này nói về điều 35 của luật")[0] == ("ARTICLE", "1")
    assert len(kinds(spark, "Điều 1. A\nPhụ lục kèm theo là bảng")) == 1


def test_glued_upper_case_title(spark):
    assert kinds(spark, "CHƯƠNG QUY ĐỊNH Điều 1. Phạm vi\n1. Một") == [("ARTICLE", "1"), ("CLAUSE", "1")]


def test_levels_close_and_count(spark):
    source = "Điều 1. A\n1. b\na) c\nb) d\nmore\n2. e\na) f\nChương II\n1. lost\nMục 3\nĐiều 2. G\na) text\n1. h"
    rows = read(spark, source)
    assert [(r["level"], r["canonical_path"].split("/", 2)[2], r["position"], r["chapter"], r["section"]) for r in rows] == [
        ("ARTICLE", "1", 1, "", ""), ("CLAUSE", "1/1", 1, "", ""), ("POINT", "1/1/a", 1, "", ""), ("POINT", "1/1/b", 2, "", ""), ("CLAUSE", "1/2", 2, "", ""), ("POINT", "1/2/a", 1, "", ""),
        ("ARTICLE", "2", 2, "II", "3"), ("CLAUSE", "2/1", 1, "II", "3"),
    ]
    assert [r["text"] for r in rows][3] == "b) d\nmore" and rows[6]["text"] == "Điều 2. G\na) text" and rows[6]["heading"] == "G"


def test_quarantine(spark):
    rows = {(r["document_id"], r["canonical_path"]): r["quarantined"] for r in documents.q_hierarchy(spark, "").collect()}
    assert rows["d1", "d1/MAIN_BODY/35"] is False
    assert rows["d3", "d3/MAIN_BODY/11/1"] is True  # repeated clause number
    assert rows["d3", "d3/MAIN_BODY/11"] is False


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([("a", None), ("b", "")], "document_id string, text string")
    assert S.provisions(docs).count() == S.segments(docs).count() == 0


def test_headings(spark):
    got = {(r["label"], r["number"], r["title"]) for r in documents.q_headings(spark, "").collect()}
    assert got == {("Chapter", "I", "Chung"), ("Section", "1", ""), ("Chapter", "II", ""), ("Section", "1", "Riêng")}


def test_versions(spark):
    rows = documents.q_provision_versions(spark, "").collect()
    by = {r["canonical_path"]: r["status"] for r in rows}
    assert by["d1/MAIN_BODY/35"] == "REVIEWED_PROVISION"
    assert by["d1/MAIN_BODY/35/1"] == "REVIEWED_INSTRUMENT_COVERAGE"
    assert by["d2/MAIN_BODY/1"] == "INHERITED_DOCUMENT"
    assert by["d3/MAIN_BODY/12"] == "UNKNOWN"


def test_alignment(spark):
    assert alignment.shifts("b c", "a b c") == [(0, 2)]
    assert alignment.shifts("x", "x x") is None
    assert {r["id"]: r["outer_at"] for r in documents.q_align(spark, "").collect()} == {1: 4, 2: 4, 3: None, 4: None}


def test_reading_lines(spark):
    assert documents.q_reading_lines(spark, "").first()["lines"] == "1. Quyền|của họ"


def test_conflicts(spark):
    got = {(r["identity"], r["left"], r["right"]) for r in documents.q_conflicts(spark, "").collect()}
    assert got == {("a", "v1", "v2"), ("a", "v2", "v1")}


def test_located_phrases(spark):
    got = {r["id"]: (r["status"], r["start"], r["evidence"]) for r in answer.q_phrase_spans(spark, "").collect()}
    assert got[1] == ("RESOLVED", 6, "lao  động có\nquyền")
    assert got[2] == ("AMBIGUOUS", None, None)
    assert got[3] == ("RESOLVED", 0, "x (1)")
    assert got[4][0] == got[5][0] == "UNRESOLVED"


def test_question_analysis(spark):
    columns = ("qid", "issues", "query_date", "precision", "outcome", "temporal_intent", "route", "n_missing", "slots")
    got = sorted(tuple(r[c] for c in columns) for r in text.q_query_analysis(spark, "").collect())
    assert got == text._ANALYSED


def test_compression_by_brute_force(spark):
    sample = [("a bb\nthe cccc dddd\nbb cccc", "cccc"), ("x" * 701 + "\nshort", "none"), ("", "q"), (None, "q")]
    rows = spark.createDataFrame(sample, "t string, q string").select("t", "q", evidence.compress(F.col("t"), F.col("q"), 20, ("the ",)).alias("k")).collect()
    assert [r["k"] for r in rows] == ["a bb\nthe cccc dddd", "short", "", None]


def test_passages_of_any_length(spark):
    """Brute force over passages of 1 to 6 words in texts of 1 to 7 words, cut within words, too."""
    import random

    from tessera.operators.evidence import occurrences

    rng = random.Random(2)
    words = ["a", "ab", "aba", "b ", "c", "cab", "é"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for i in range(120)}
    phrases = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))[rng.randint(0, 1) :] for i in range(80)}
    texts |= {500: None, 501: "", 502: "c"}
    phrases |= {600: None, 601: "", 602: "c", 603: " "}
    docs, items = (spark.createDataFrame(list(x.items()), "id int, body string") for x in (texts, phrases))
    got = sorted(map(tuple, occurrences(docs.withColumnRenamed("id", "doc_id"), "doc_id", "body", items.withColumnRenamed("id", "item_id"), "item_id", "body").collect()))
    assert got == sorted((d, i, t.count(p), t.index(p)) for d, t in texts.items() for i, p in phrases.items() if t and p and p in t)
