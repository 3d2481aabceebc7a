"""Sources: file manifests, JSON lines, seeds with a contract, catalogs, whole texts, archives of tables."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.legal import classify_path
from tessera.functions.text import stable_id

#: Fixed values.
SUPPORTED = (".pdf", ".doc", ".docx", ".html", ".htm", ".txt", ".json")
SIDECARS = ("SOURCE_AUTHORITY.JSON", "SOURCE_METADATA.JSON")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per supported file under root: ids, size, digest, group, type, binding flag. Sidecar files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/") + "/"
    relative = F.substring_index(F.col("path"), bare, -1)
    rows = files.select("path", relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    name = F.element_at(F.split("relative_path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    rows = rows.withColumn("filename", name).withColumn("extension", extension)
    rows = rows.filter(F.col("extension").isin(*SUPPORTED) & ~F.upper("filename").isin(*SIDECARS))
    group, kind, binding = classify_path(F.col("relative_path"))
    return rows.select(stable_id("file", F.col("relative_path"), F.col("sha256")).alias("file_id"), "*", group.alias("source_group"), kind.alias("document_type_hint"), binding.alias("binding_default"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a missing file has none, blank lines don't count, a byte-order mark is dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\x{FEFF}", "").alias("value")).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain files, each one row."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def seed(spark: SparkSession, path: str, required: list[str], key: str = "relative_path", expected_rows: int | None = None) -> DataFrame:
    """A CSV seed with all required headers, trimmed; keys must be unique and stay below their root. Raises otherwise."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    lacking = sorted(set(required) - set(rows.columns))
    if lacking:
        raise ValueError(f"seed lacks headers: {lacking}")
    rows = rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns])
    escaped = F.col(key).startswith("/") | F.array_contains(F.split(F.col(key), r"[/\\]"), "..")
    check = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.count_if(escaped).alias("escaped")).first()
    if check["escaped"]:
        raise ValueError("seed paths leave their root")
    if check["keys"] != check["n"]:
        raise ValueError("seed paths repeat")
    if expected_rows is not None and check["n"] != expected_rows:
        raise ValueError(f"seed has {check['n']} rows, not {expected_rows}")
    return rows


def catalog(spark: SparkSession, text: str, section: str, schema: str, key: str) -> DataFrame:
    """A YAML mapping (its text, whose size a person can write) as a table: one row per entry, its name as `key`."""
    entries = (yaml.safe_load(text) or {}).get(section) or {}
    fields = T._parse_datatype_string(schema)
    rows = []
    for name, values in entries.items():
        unknown = set(values or {}) - set(fields.names)
        if unknown:
            raise ValueError(f"unknown fields in {section}: {sorted(unknown)}")
        rows.append((str(name), *[(values or {}).get(f) if not hasattr((values or {}).get(f), "isoformat") else (values or {}).get(f).isoformat() for f in fields.names]))
    return spark.createDataFrame(rows, T.StructType([T.StructField(key, T.StringType()), *fields.fields]))


def pending(manifest_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest rows without a finished result under the same keys (file, digest, settings): what a resumed run does."""
    return manifest_rows.join(done.select(*keys), keys, "left_anti")
