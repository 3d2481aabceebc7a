"""Provider adapters as a table function: what pages offer, by the rules of the provider that each belongs to.

The function's analysis reads the rules, which are a constant, and asks for pages partitioned by provider, so that an
adapter is made once for all pages that a task holds of it. A provider with many pages lies in several parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from tessera.sources.html import DOWNLOAD_HINTS, FILE_ENDINGS, read_page

#: Rules of a provider without its own: endings of files, words of download controls, (host, path) that serve files.
GENERIC = {"endings": list(FILE_ENDINGS), "hints": list(DOWNLOAD_HINTS), "endpoints": []}
#: Pages of a provider that a part has about.
PART = 10_000


class Adapter:
    """One provider's reading of a page."""

    def __init__(self, provider: str, rules: dict):
        known = GENERIC | rules.get("*", {}) | rules.get(provider, {})
        self.endings = tuple(x.lower() for x in known["endings"])
        self.hints = [x.casefold() for x in known["hints"]]
        self.endpoints = {tuple(x) for x in known["endpoints"]}

    def role(self, url: str, label: str, href: str) -> str | None:
        parts = urlsplit(url)
        if self.endings and parts.path.lower().endswith(self.endings) or (parts.hostname, parts.path) in self.endpoints:
            return "BINARY"
        return "DOWNLOAD_CONTROL" if any(h in f"{label} {href}".casefold() for h in self.hints) else None

    def links(self, html: str | None, base: str | None) -> Iterator[tuple[str, str, str]]:
        """(absolute URL, label, role), each URL of a page once."""
        seen = set()
        for href, label in read_page(html).links:
            try:
                url = urljoin(base or "", href.strip())
                role = self.role(url, label, href)
            except ValueError:  # no URL at all
                continue
            if role and url not in seen:
                seen.add(url)
                yield url, " ".join(label.split()) or href, role


def _checked(rules: str | None) -> dict:
    found = json.loads(rules) if rules else {}
    if not isinstance(found, dict) or any(not isinstance(r, dict) or set(r) - set(GENERIC) for r in found.values()):
        raise ValueError(f"rules are a JSON object of providers, each with some of {sorted(GENERIC)}")
    return found


class Discover:
    """pages: a table with provider, part, page, url, html; rules: a constant JSON object by provider, `*` for all."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not rules.isConstantExpression:
            raise ValueError("discover takes a table and constant rules")
        _checked(rules.value)
        page = pages.dataType["page"].dataType
        fields = [("provider", StringType()), ("page", page), ("url", StringType()), ("label", StringType()), ("role", StringType())]
        return AnalyzeResult(StructType([StructField(n, t) for n, t in fields]), partitionBy=[PartitioningColumn("provider"), PartitioningColumn("part")])

    def __init__(self):
        self.adapters: dict = {}

    def eval(self, pages: Row, rules: str) -> Iterator[tuple]:
        provider = pages["provider"]
        if provider not in self.adapters:
            self.adapters = {provider: Adapter(provider, _checked(rules))}
        for found in self.adapters[provider].links(pages["html"], pages["url"]):
            yield provider, pages["page"], *found


def attachments(pages: DataFrame, page: str, provider: Column, url: str, html: str, rules: dict | None = None) -> DataFrame:
    """provider, url, role, label, page, pages: what a provider's pages offer, each URL once with the first page (by `page`)
    that offers it and the number of pages that do. Null pages and pages without a provider (null) offer nothing."""
    rows = pages.select(provider.alias("provider"), F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")).filter("provider is not null and html is not null")
    large = rows.groupBy("provider").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")  # at most pages / PART rows
    dealt = rows.join(F.broadcast(large), "provider", "left").withColumn("part", F.pmod(F.xxhash64("page"), F.coalesce("parts", F.lit(1))).cast("int"))
    found = udtf(Discover)(dealt.select("provider", "part", "page", "url", "html").asTable(), F.lit(json.dumps(rules or {})))
    first = F.min(F.struct("page", "role", "label")).alias("first")
    out = found.groupBy("provider", "url").agg(first, F.count_distinct("page").alias("pages"))
    return out.select("provider", "url", "first.role", "first.label", "first.page", "pages")
