"""Registry, cases, citations and units against expected rows."""

import pytest

from tessera.operators import corpus
from tessera.plans import build


def test_registry(spark):
    rows = {r["relative_path"]: r for r in build.q_registry(spark, "").collect()}
    law, decree, case = (rows[p] for p, *_ in build.DOCS)
    assert (law["document_number"], str(law["effective_from"]), law["title"], law["issuer"], law["instrument_type"]) == ("45/2019/QH14", "2021-01-01", "BỘ LUẬT LAO ĐỘNG", "Quốc hội", "LAW")
    assert (decree["document_number"], decree["effective_from"], decree["issuer"], decree["instrument_type"]) == ("145/2020/NĐ-CP", None, "Chính phủ", "DECREE")
    assert (case["document_number"], case["case_number"], case["issuer"], case["instrument_id"]) == (None, "02/2025/LĐPT", "TAND", None)


def test_case_sections(spark):
    row = build.q_case_sections(spark, "").first()
    assert row["facts"].startswith(": bị đơn") and row["reasoning"] == ": có căn cứ." and row["decision"] == ": chấp nhận."
    plain = spark.createDataFrame([("không có mục nào",), ("",), (None,)], "t string")
    got = [tuple(r) for r in plain.select(*corpus.case_sections(corpus.F.col("t")).values()).collect()]
    assert got == [("không có mục nào", "", ""), ("", "", ""), ("", "", "")]


def test_relations(spark):
    got = sorted((r["type"], r["target"], r["confidence"]) for r in build.q_relations(spark, "").collect())
    assert got == [("AMENDS", "36", 0.82), ("CITES", "35", 0.98), ("IMPLEMENTS", "35/1/a", 0.82), ("REFERENCES", "35/1", 0.93), ("REFERENCES", "35/1/a", 0.98), ("REFERENCES", "36", 0.95)]


def test_threshold_and_unresolved(spark):
    cited = build._citations(spark)
    assert corpus.relation_edges(cited, 0.99).count() == 0
    docs = spark.createDataFrame([("d1", "1/2020/ND-CP", 100), ("d2", "1/2020/NĐ-CP", 100)], "document_id string, document_number string, authority_rank int")
    provisions = spark.createDataFrame([("p", "d1", "35", "", "")], "provision_id string, document_id string, article_number string, clause_number string, point_number string")
    sources = spark.createDataFrame([("c1", None, "theo điều 35"), ("c2", None, "Điều 35 Nghị định 1/2020/NĐ-CP")], "source_id string, owner string, text string")
    alias = spark.createDataFrame([], "alias string, document_id string")
    assert {r["status"] for r in corpus.citations(sources, docs, provisions, alias).collect()} == {"UNRESOLVED"}  # no instrument; two equal documents


def test_units(spark):
    rows = {r["breadcrumb"]: r for r in build.q_retrieval_units(spark, "").collect()}
    point = rows["BỘ LUẬT LAO ĐỘNG > Điều 35 > khoản 1 > điểm a"]
    assert point["ancestor_context"].split("\n")[0] == "Điều 35. Quyền chấm dứt hợp đồng"
    assert len(rows) == 6


def test_allow_list(spark):
    with pytest.raises(ValueError):
        corpus.checked_columns(spark.range(1), {"other"})


def test_trees_of_any_depth(spark):
    import pytest

    from tessera.operators import graph

    rows = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(12)], "id string, parent string, label string")
    got = {r["id"]: (r["breadcrumb"], r["depth"]) for r in graph.breadcrumbs(rows, "id", "parent", "label").collect()}
    assert got["0"] == ("n0", 0) and got["11"] == (" > ".join(f"n{i}" for i in range(12)), 11)
    below = graph.descendants(rows, "id", "parent", rows.filter("id = '7'"))
    assert sorted(int(r["id"]) for r in below.collect()) == [7, 8, 9, 10, 11]
    ring = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("c", "a", "C")], "id string, parent string, label string")
    assert graph.descendants(ring, "id", "parent", ring.filter("id = 'a'")).count() == 3
    with pytest.raises(ValueError):
        graph.breadcrumbs(ring, "id", "parent", "label")
