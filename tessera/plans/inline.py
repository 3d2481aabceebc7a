"""Small tables stated once, for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """columns: `name type, ...` as in Spark DDL."""
    return spark.createDataFrame(rows, columns)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def _sql_type(kind: str) -> str:
    if kind.startswith("array<"):
        return _sql_type(kind[6:-1]) + "[]"
    return _TYPES[kind]


def cte(name: str, columns: str, rows: list[tuple]) -> str:
    """`name AS (...)` with the same rows, typed."""
    fields = [c.strip().split(" ", 1) for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {_sql_type(t.strip())}) AS {n}" for n, t in fields)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) AS t({', '.join(n for n, _ in fields)}))"
