"""Files with an inner structure, read as binary files by Spark and taken apart on the executors: DOCX, ZIP, SQLite.

A file is one row and must fit a worker's memory; files that can't be read give a row with an error and no content.
"""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _taken_apart(files: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """path, the fields that read() yields, error: rows of each file in order."""
    fields = T._parse_datatype_string(schema)
    out_schema = T.StructType([T.StructField("path", T.StringType()), *fields.fields, T.StructField("error", T.StringType())])
    width = len(fields.fields)
    arrow = [pa.string() if isinstance(f.dataType, T.StringType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(path, *r, None) for r in read(content.as_py())]
                except Exception as error:  # noqa: BLE001 - whatever a damaged file raises is its result
                    rows = [(path, *[None] * width, f"{type(error).__name__}: {error}")]
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, (pa.string(), *arrow, pa.string()))], out_schema.names)

    return files.mapInArrow(run, out_schema)


def _paragraph(node: ElementTree.Element) -> str:
    kinds = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n", f"{_W}cr": lambda x: "\n"}
    return "".join(kinds[x.tag](x) for x in node.iter() if x.tag in kinds)


def _table(node: ElementTree.Element) -> Iterator[str]:
    """A line per row, cells between bars; a cell over several columns or rows stands in each of them."""
    above: list[str] = []
    for row in node.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val") != "restart" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * int(span.get(f"{_W}val")) if span is not None else [text]
        above = cells
        yield " | ".join(cells)


def read_docx(content: bytes) -> str:
    """Paragraphs that aren't blank and rows of tables, in the document's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    blocks: list[str] = []
    for node in body:
        if node.tag == f"{_W}tbl":
            blocks += _table(node)
        elif node.tag == f"{_W}p" and (text := _paragraph(node)).strip():
            blocks.append(text)
    return "\n".join(blocks)


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of every DOCX file."""
    return _taken_apart(_binary(spark, path), lambda content: iter([(read_docx(content),)]), "text string")


def _members(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            name = info.filename.replace("\\", "/")
            if not info.is_dir():
                safe = not name.startswith("/") and ".." not in name.split("/")
                yield name, info.file_size, archive.read(info) if safe else None


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, size_bytes, content, error: every file in every archive; names that leave it have no content."""
    return _taken_apart(_binary(spark, path), _members, "member string, size_bytes long, content binary")


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """path, the columns of schema (string, long, double or binary), error: the rows of a table in every SQLite file."""
    names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in T._parse_datatype_string(schema).fields)
    source = table.replace('"', '""')

    def rows(content: bytes) -> Iterator[tuple]:
        database = sqlite3.connect(":memory:")
        try:
            database.deserialize(content)
            yield from database.execute(f'SELECT {names} FROM "{source}" ORDER BY rowid')
        finally:
            database.close()

    return _taken_apart(_binary(spark, path), rows, schema)
