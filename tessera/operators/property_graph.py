"""A property graph as two tables: nodes (id, label, layer, properties) and edges (id, source, target, type, confidence,
properties). Properties are JSON of the columns named, without nulls."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stable_id
from tessera.operators.intervals import prefix_sum
from tessera.sources.scratch import store


def _json(properties: list[str]) -> Column:
    return F.to_json(F.struct(*properties)) if properties else F.lit("{}")


def node_rows(rows: DataFrame, key: Column, label: Column, layer: str, properties: list[str] = []) -> DataFrame:  # noqa: B006 - never changed
    """A node for each row whose key isn't null."""
    return rows.filter(key.isNotNull()).select(key.cast("string").alias("id"), label.alias("label"), F.lit(layer).alias("layer"), _json(properties).alias("properties"))


def edge_rows(rows: DataFrame, source: Column, target: Column, kind: str, confidence: Column | None = None, properties: list[str] = []) -> DataFrame:  # noqa: B006
    """An edge for each row whose ends aren't null; its id follows from ends, type, confidence and properties."""
    sure = F.lit(None).cast("double") if confidence is None else confidence.cast("double")
    out = rows.filter(source.isNotNull() & target.isNotNull()).select(source.cast("string").alias("source"), target.cast("string").alias("target"), F.lit(kind).alias("type"), sure.alias("confidence"), _json(properties).alias("properties"))
    parts = [F.col("source"), F.col("target"), F.col("type"), F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.col("properties")]
    return out.select(stable_id("edge", *parts).alias("id"), "*")


def sibling_edges(rows: DataFrame, parent: str, order: list[str], key: str, kind: str = "NEXT") -> DataFrame:
    """Edges from each row to its next sibling. Siblings are numbered by a segmented scan and meet by number, so that a
    parent with a third of all rows stays spread. Ties in order are told by key."""
    places = prefix_sum(rows.filter(F.col(key).isNotNull()).select(F.col(parent).alias("up"), *order, F.col(key).alias("one")), ["up"], [*order, "one"], F.lit(1), "place")
    ahead = places.select(F.col("up").alias("up_"), F.col("one").alias("other"), (F.col("place") - 1).alias("place_"))
    both = places.join(ahead, F.col("up").eqNullSafe(F.col("up_")) & (F.col("place") == F.col("place_")))
    return edge_rows(both, F.col("one"), F.col("other"), kind)


def property_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all parts. Equal rows count once; two different nodes of one id raise, as one would overwrite the
    other. Edges whose ends aren't nodes stay, for validation."""
    together = functools.reduce(DataFrame.unionByName, nodes)
    kept = store(together.groupBy("id").agg(F.min(F.struct("label", "layer", "properties")).alias("n"), F.max(F.struct("label", "layer", "properties")).alias("m")), "nodes")
    clash = [r["id"] for r in kept.filter(~F.col("n").eqNullSafe(F.col("m"))).select("id").limit(5).collect()]
    if clash:
        raise ValueError(f"different nodes share an id: {clash}")
    return kept.select("id", "n.*"), functools.reduce(DataFrame.unionByName, edges).dropDuplicates(["id"])
