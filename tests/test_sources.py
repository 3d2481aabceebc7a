import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.sources import files, html, sinks
from tessera.streaming.ingest import ingest_documents


def test_manifest(spark, tmp_path):
    for name in ("laws/45-2019-QH14.txt", "x/SOURCE_METADATA.json", "ilo/a.html", "skip.bin"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("text")
    rows = {r["filename"]: r for r in files.manifest(spark, f"file:{tmp_path}").collect()}
    assert set(rows) == {"45-2019-QH14.txt", "a.html"}
    assert rows["a.html"]["source_group"] in ("SUPPLEMENTARY", "UNKNOWN")


def test_json_lines_and_missing_file(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r["a"] for r in files.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    assert files.json_lines(spark, str(tmp_path / "none"), "a int").count() == 0


def test_seed_contract(spark, tmp_path):
    def seed(body, **more):
        p = tmp_path / f"{abs(hash(body))}.csv"
        p.write_text(body)
        return files.seed(spark, str(p), ["relative_path", "url"], **more)

    assert seed("relative_path,url\n a/1 ,x\n").first()["relative_path"] == "a/1"
    for bad in ("relative_path\na\n", "relative_path,url\n../a,x\n", "relative_path,url\na,x\na,y\n"):
        with pytest.raises(ValueError):
            seed(bad)
    with pytest.raises(ValueError):
        seed("relative_path,url\nb,x\n", expected_rows=2)


def test_catalog(spark):
    rows = files.catalog(spark, "sources:\n  a/1: {reviewer: r, reviewed_at: 2025-01-01}\n", "sources", "reviewer string, reviewed_at string", "path").collect()
    assert [tuple(r) for r in rows] == [("a/1", "r", "2025-01-01")]
    with pytest.raises(ValueError):
        files.catalog(spark, "s: {x: {bad: 1}}", "s", "reviewer string", "path")


def test_html():
    page = "<nav>menu</nav><p>Hello <b>you</b></p><script>x()</script><a href='/f.PDF'>File</a><a href='/g'>Download</a><a href='/f.PDF'>again</a>"
    assert html.page_text(page) == "Hello\nyou\nFile\nDownload\nagain"
    assert html.download_links(page, "https://a.example/b") == [("https://a.example/f.PDF", "File", "BINARY"), ("https://a.example/g", "Download", "DOWNLOAD_CONTROL")]
    assert html.page_text(None) == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "b"})], "id int, props map<string,string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "c")).first()["props"] == '{"a":"b"}'
    ids = df.select("id")
    assert sinks.verify_load(ids, ids) and not sinks.verify_load(ids, ids.union(ids))
    assert sinks.with_defaults(ids, {"x": "y"}, ["id"]).columns == ["x"]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(source)
    ingest_documents(spark, source, "doc_id long, text string", target, str(tmp_path / "ck1")).awaitTermination()
    ingest_documents(spark, source, "doc_id long, text string", target, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_answers(spark):
    units = spark.createDataFrame(
        [("prov_1", "Điều 1. Nghỉ hằng năm 12 ngày", "145/2020/NĐ-CP", "1", "", "", 100, True, "https://g/1", True, "2020-01-01", None, True, True), ("prov_2", "Điều 2. Tiền lương tối thiểu", "145/2020/NĐ-CP", "2", "", "", 100, True, "https://g/2", True, "2020-01-01", None, True, False)],
        "unit_id string, text string, document_number string, article_number string, clause_number string, point_number string, authority_rank int, binding boolean, source_url string, official_source boolean, valid_from string, valid_to string, temporal_verified boolean, provision_verified boolean",
    ).withColumn("valid_from", F.to_date("valid_from")).withColumn("valid_to", F.to_date("valid_to"))
    asked = spark.createDataFrame([("Điều 1 nghị định 145/2020/NĐ-CP quy định gì?",), ("Sa thải có đúng luật không?",), ("zzz",)], "question string")
    got = {r["question"]: r for r in api.answer(asked, units, "2026-01-01").collect()}
    direct = got["Điều 1 nghị định 145/2020/NĐ-CP quy định gì?"]
    assert (direct["route"], direct["state"], direct["citations"]) == ("DIRECT", "SUFFICIENT", ["prov_1"])
    assert got["Sa thải có đúng luật không?"]["state"] == "NEED_MORE_FACTS"
    assert got["zzz"]["state"] == "INSUFFICIENT_EVIDENCE"
    # two texts of one place, both in force
    other = units.filter("unit_id = 'prov_2'").select(F.lit("prov_9").alias("unit_id"), F.lit("Tiền lương tối thiểu do hội đồng khác hẳn ấn định hằng quý theo vùng").alias("text"), *[c for c in units.columns if c not in ("unit_id", "text")])
    question = spark.createDataFrame([("Tiền lương tối thiểu được quy định thế nào?",)], "question string")
    assert api.answer(question, units.unionByName(other), "2026-01-01").first()["state"] == "CONFLICTING_EVIDENCE"
    assert api.answer(question, units, "2026-01-01").first()["state"] != "CONFLICTING_EVIDENCE"


def test_document_numbers(spark):
    from pyspark.sql import functions as F

    from tessera.functions import legal

    rows = [
        ("Luat 45-2019-QH14.pdf", "", "45/2019/QH14"), ("145_2020_NĐ-CP (1).docx", "", "145/2020/NĐ-CP"), ("10-2020-TT-BLDTBXH.pdf", "", "10/2020/TT-BLĐTBXH"),
        ("09_2020_TT_BNV.pdf", "", "09/2020/TT-BNV"), ("06-2018-NQ-HDTP.html", "", "06/2018/NQ-HĐTP"), ("1003-2020-NQ-UBTVQH14.pdf", "", "1003/2020/NQ-UBTVQH14"), ("10-2014-UBTVQH13.txt", "", "10/2014/UBTVQH13"),
        ("595-QĐ-BHXH.pdf", "", "595/QĐ-BHXH"), ("07_VBHN-VPQH.pdf", "", "07/VBHN-VPQH"), ("12345-2019-QH14.pdf", "", None), ("45-2019-QH14x.pdf", "", None), ("45-QH14.pdf", "", None),
        ("luat.pdf", "QUỐC HỘI\n Luật số: 58/2014/qh13\nSố: 1/2020/NĐ-CP", "58/2014/QH13"), ("nd.pdf", "theo Luật 45/2019/QH14\nSố: 12/2022/ND-CP", "12/2022/NĐ-CP"), ("none.pdf", "Căn cứ Luật 45/2019/QH14", None), ("null.pdf", None, None),
    ]
    df = spark.createDataFrame(rows, "name string, text string, want string")
    got = df.select("name", "want", legal.document_number(F.col("name"), F.col("text")).alias("got")).collect()
    assert {r["name"]: r["got"] for r in got} == {r["name"]: r["want"] for r in got}


def test_date_of_effect_is_the_instruments_own(spark):
    from pyspark.sql import functions as F

    from tessera.functions import legal

    rows = [
        ("Điều 9\n1. Luật này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2021.\n2. Luật số 10 hết, có hiệu lực từ ngày 1/2/2022.", "2021-01-01"),
        ("Theo nghị định khác có hiệu lực từ ngày 1/1/2020.", None),
        ("Xong. Nghị định này có biệu lực kể từ ngày 3O/11/2025", None),
        ("Nghị định này có hiệu lực từ ngày 0l/11/2025; Thông tư này có hiệu lực từ ngày 1/11/2025.", "2025-11-01"),
        ("Luật này " + "x " * 300 + "có hiệu lực từ ngày 1/1/2020", None),
        ("Luật này có hiệu lực từ ngày 1/7/2024. Nghị định này có hiệu lực kể từ ngày 15/8/2024.", None),
        (None, None), ("", None),
    ]
    df = spark.createDataFrame(rows, "text string, want string")
    got = df.select("text", "want", legal.effective_date(F.col("text")).cast("string").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_structured_files(spark, tmp_path):
    import sqlite3
    import zipfile

    from tessera.sources import archives

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    t = lambda x: f"<w:t>{x}</w:t>"
    cell = lambda x, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t(x))}</w:tc>"
    body = p(t("Head"), t("er")) + p(t("  ")) + "<w:tbl><w:tr>" + cell("a", '<w:vMerge w:val="restart"/>') + cell(" b ") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("c") + "</w:tr><w:tr>" + cell("d", '<w:gridSpan w:val="2"/>') + "</w:tr></w:tbl>" + p(t("x"), "<w:tab/>", t("y"), "<w:br/>", t("z"))
    (tmp_path / "docs").mkdir()
    with zipfile.ZipFile(tmp_path / "docs/one.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "docs/bad.docx").write_bytes(b"not a zip")
    got = {r["path"].rsplit("/", 1)[1]: r for r in archives.docx_texts(spark, str(tmp_path / "docs")).collect()}
    assert got["one.docx"]["text"] == "Header\na | b\na | c\nd | d\nx\ty\nz" and got["one.docx"]["error"] is None
    assert got["bad.docx"]["text"] is None and "BadZipFile" in got["bad.docx"]["error"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "text")
        z.writestr("../out.txt", "no")
        z.writestr("dir/", "")
    rows = {r["member"]: (r["size_bytes"], r["content"] and bytes(r["content"])) for r in archives.zip_members(spark, str(tmp_path / "a.zip")).collect()}
    assert rows == {"in/x.txt": (4, b"text"), "../out.txt": (2, None)}
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute('CREATE TABLE "the rows" (id INTEGER, name TEXT, score REAL)')
    db.executemany('INSERT INTO "the rows" VALUES (?, ?, ?)', [(1, "a", 0.5), (2, None, None)])
    db.commit()
    db.close()
    rows = [tuple(r)[1:] for r in archives.sqlite_rows(spark, str(tmp_path / "s.db"), "the rows", "id long, name string, score double").collect()]
    assert rows == [(1, "a", 0.5, None), (2, None, None, None)]
    assert "no such table" in archives.sqlite_rows(spark, str(tmp_path / "s.db"), "none", "id long").first()["error"]
