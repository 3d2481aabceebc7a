"""Adapters: rules by provider, roles, first pages."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import providers as P

PAGES = [
    (1, "a", "https://a.vn/x/", '<a href="y.pdf">Bản gốc</a><a href="/d?id=1">Tải về</a><a href="y.pdf">again</a><a href="z.html">z</a>'),
    (2, "a", "https://a.vn/x/", '<a href="/x/y.pdf"></a><a href="http://[bad">Download</a>'),
    (3, "b", "https://b.vn/", '<a href="get?k=2">lấy</a><a href="w.PDF">w</a><a href="https://cdn.vn/api/stream?u=1">tệp</a>'),
    (4, None, "https://c.vn/", '<a href="q.pdf">q</a>'),
    (5, "b", None, None),
    (6, "b", None, '<a href="v.zip">v</a>'),
]
RULES = {"b": {"endings": [".zip"], "hints": ["get?"], "endpoints": [["cdn.vn", "/api/stream"]]}}


@pytest.mark.parametrize("part", [1, 10_000])
def test_rules_of_each_provider(spark, monkeypatch, part):
    monkeypatch.setattr(P, "PART", part)
    df = spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, host string, address string, source string, url string")
    got = sorted(map(tuple, P.attachments(df, "page_id", F.col("host"), "address", "source", RULES).collect()))
    assert got == [
        ("a", "https://a.vn/d?id=1", "DOWNLOAD_CONTROL", "Tải về", 1, 1),
        ("a", "https://a.vn/x/y.pdf", "BINARY", "Bản gốc", 1, 2),
        ("b", "https://b.vn/get?k=2", "DOWNLOAD_CONTROL", "lấy", 3, 1),
        ("b", "https://cdn.vn/api/stream?u=1", "BINARY", "tệp", 3, 1),
        ("b", "v.zip", "BINARY", "v", 6, 1),
    ]
    assert P.attachments(df.limit(0), "page_id", F.col("host"), "address", "source").count() == 0


def test_analysis_refuses_wrong_rules(spark):
    df = spark.createDataFrame(PAGES, "page_id long, host string, address string, source string")
    with pytest.raises(Exception, match="rules are a JSON object"):
        P.attachments(df, "page_id", F.col("host"), "address", "source", {"a": {"ending": []}})
