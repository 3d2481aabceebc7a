"""Text and download links of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import small_batches

#: Fixed values.
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer"}
FILE_ENDINGS = (".pdf", ".doc", ".docx", ".zip")
DOWNLOAD_HINTS = ("download", "tải về", "tải xuống", "attachment")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.links: list[list[str]] = []
        self.hidden = 0
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append([href, ""])
            self.in_link = True

    def handle_endtag(self, tag):
        if tag in DROPPED and self.hidden:
            self.hidden -= 1
        if tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if self.in_link:
            self.links[-1][1] += data
        if not self.hidden and (text := data.strip()):
            self.texts.append(text)


def read_page(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def page_text(html: str | None, separator: str = "\n") -> str:
    """Visible text, pieces joined by the separator."""
    return separator.join(read_page(html).texts)


def download_links(html: str | None, base: str | None) -> list[tuple[str, str, str]]:
    """(absolute URL, label, role) of links to files and download controls, first of each URL."""
    out: dict[str, tuple[str, str, str]] = {}
    for href, label in read_page(html).links:
        try:
            url = urljoin(base or "", href.strip())
            ending = urlsplit(url).path.lower().endswith(FILE_ENDINGS)
        except ValueError:
            continue
        hint = any(h in f"{label} {href}".lower() for h in DOWNLOAD_HINTS)
        if ending or hint:
            out.setdefault(url, (url, " ".join(label.split()), "BINARY" if ending else "DOWNLOAD_CONTROL"))
    return list(out.values())


def texts(pages: DataFrame, key: str, html: str, separator: str = "\n") -> DataFrame:
    """key, text of every page; null pages have empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [page_text(x, separator) for x in b["html"]]})

    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col(html).alias("html")).mapInPandas(run, f"{key} {kind}, text string")


def links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, url, label, role: a row per link kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *found) for k, h, u in zip(b[key], b["html"], b["base"]) for found in download_links(h, u)]
            yield pd.DataFrame(rows, columns=[key, "url", "label", "role"])

    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col(html).alias("html"), F.col(url).alias("base")).mapInPandas(run, f"{key} {kind}, url string, label string, role string")
