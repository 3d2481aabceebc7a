"""Sinks: JSON lines, CSV with nested columns as JSON, reports, and exact verification after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def flattened(rows: DataFrame) -> DataFrame:
    """rows with nested columns as JSON text."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return rows.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema])


def write_csv(rows: DataFrame, path: str) -> None:
    flattened(rows).write.mode("overwrite").option("header", "true").csv(path)


def with_defaults(rows: DataFrame, defaults: dict[str, object], drop: list[str]) -> DataFrame:
    """rows with columns added or their nulls filled, and some dropped."""
    out = rows
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return out.drop(*drop)


def differences(left: DataFrame, right: DataFrame, key: list[str], field: str) -> DataFrame:
    """key, before, after where a proposal changes a field: a report, never applied by itself."""
    both = left.select(*key, F.col(field).alias("before")).join(right.select(*key, F.col(field).alias("after")), key)
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def verify_load(source: DataFrame, loaded: DataFrame) -> bool:
    """Whether both tables hold the same rows equally often."""
    return source.exceptAll(loaded).isEmpty() and loaded.exceptAll(source).isEmpty()


def report(issues: DataFrame) -> str:
    """A short text: counts by severity and type, which are few."""
    rows = issues.groupBy("severity", "type").agg(F.count("*").alias("n")).orderBy("severity", "type").collect()
    return "\n".join(["| severity | type | n |", "| --- | --- | --- |", *[f"| {r['severity']} | {r['type']} | {r['n']} |" for r in rows]])
