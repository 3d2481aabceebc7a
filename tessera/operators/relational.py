"""Joins, aggregates, ordered operators and set operations with the semantics of dictionary-based pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import store


def last_by_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Of each key the last row's values at the first row's position (as a dictionary filled in order would have them)."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), ordinal).alias("__last")
    out = rows.groupBy(*key).agg(last, F.min(ordinal).alias("position"))
    return out.select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest if c != ordinal], "position")


def first_by_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def fallback_lookup(rows: DataFrame, sources: list[tuple[DataFrame, list[str]]], fields: list[str]) -> DataFrame:
    """Fields from the first source (by position) that has a non-empty value for the row, field by field.

    Each source is (table, key columns shared with rows); keys of a source are unique.
    """
    out = rows
    for i, (source, key) in enumerate(sources):
        out = out.join(source.select(*key, *[F.col(f).alias(f"__{i}_{f}") for f in fields]), key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(*[F.when(F.col(f"__{i}_{f}").cast("string") != "", F.col(f"__{i}_{f}")) for i in range(len(sources))]))
    return out.drop(*[f"__{i}_{f}" for i in range(len(sources)) for f in fields])


def unique_match(left: DataFrame, right: DataFrame, key: list[str], target: str) -> DataFrame:
    """left with target and candidate_count: the target only where exactly one row of right has the key."""
    counted = right.groupBy(*key).agg(F.count("*").alias("candidate_count"), F.first(target).alias("__one"))
    out = left.join(counted, key, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return out.withColumn(target, F.when(F.col("candidate_count") == 1, F.col("__one"))).drop("__one")


def best_unless_tied(rows: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """key, value of the row with the largest rank, null where several rows share it."""
    w = Window.partitionBy(*key)
    top = rows.withColumn("__max", F.max(rank).over(w)).filter(F.col(rank) == F.col("__max"))
    return top.groupBy(*key).agg(F.when(F.count("*") == 1, F.first(value)).alias(value))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with `side`: what one table has more often than the other; empty when they are equal as multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with position, from 1 in the order of key. Ranges of keys are numbered apart and their sizes added up, so that
    no task holds the whole table; the ranges are stored first, as a second evaluation might draw other bounds."""
    parts = store(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return parts.withColumn("__local", local).join(sizes.select("__part", before.alias("__before")), "__part").select(*rows.columns, (F.col("__before") + F.col("__local")).alias("position"))


def fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """SHA-256 over the sorted row hashes of each group, which a task holds: for small groups. multiset_fingerprint has no
    such bound."""
    one = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return rows.select(*by, one.alias("h")).groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("fingerprint"), F.count("*").alias("n"))


def _lanes(columns: list[str]) -> list[Column]:
    """Numbers of a row out of one SHA-256: three of 60 bits and the product of two of 28 bits. Nulls are empty texts."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda at, n: F.conv(F.substring(row, at, n), 16, 10).cast("long")
    return [part(1, 15), part(16, 15), part(31, 15), part(46, 7) * part(53, 7)]


def fingerprint_lanes(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, n and the sums of every lane: what of two disjoint parts adds up to that of their union, in any order."""
    sums = [F.sum(lane.cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane_{i}") for i, lane in enumerate(_lanes(columns))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def merged_lanes(parts: DataFrame, by: list[str]) -> DataFrame:
    """Tables of fingerprint_lanes put together: a table that grows needs only the lanes of what is new."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in parts.columns if c.startswith("lane_")])


def multiset_fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, fingerprint, n: equal for equal multisets of rows in any order; a chance equality is as rare as 180 bits make it.
    (Sums don't withstand someone who makes rows to fit.)

    Every task sends one row of sums a group, however large the group is.
    """
    return sealed(fingerprint_lanes(rows, columns, by), by)


def sealed(lanes: DataFrame, by: list[str]) -> DataFrame:
    """by, fingerprint, n from sums of lanes."""
    parts = [F.col(c).cast("string") for c in lanes.columns if c == "n" or c.startswith("lane_")]
    return lanes.select(*by, F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"), "n")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], overwrite: list[str], merge: list[str], ordinal: str) -> DataFrame:
    """current with incoming rows: `overwrite` columns from the latest row, `merge` maps merged key by key in order.

    Both sides carry `ordinal`; incoming rows come after current ones.
    """
    rows = current.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    order = F.struct("__side", ordinal)
    aggregates = [F.max_by(c, order).alias(c) for c in overwrite]
    for c in merge:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("__side", ordinal, F.map_entries(c).alias("e")))), lambda x: x["e"])
        flat = F.flatten(parts)
        # the last entry of each key wins
        kept = F.filter(F.transform(flat, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(flat, e["i"] + 2, F.size(flat)), lambda later: later["key"] == e["key"]))
        aggregates.append(F.map_from_entries(F.array_sort(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))).alias(c))
    return rows.groupBy(*key).agg(*aggregates)


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """current and those incoming rows whose key it lacks."""
    return current.unionByName(incoming.join(current.select(*key), key, "left_anti"))


def diverse(rows: DataFrame, group: list[str], identity: list[str], order: list[Column], limit: Column) -> DataFrame:
    """The first row of each identity, then at most `limit` of them per group."""
    first = first_by_key(rows, [*group, *identity], order)
    return first.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("pick") <= limit)


def greedy_budget(scored: Column, budget: int) -> Column:
    """Positions picked from an array of structs (position, score, size): best score first, ties to earlier positions;
    each one is taken if it and a separator still fit, else skipped. In order of position."""
    order = F.sort_array(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["position"].alias("p"), x["size"].alias("n"))))
    start = F.struct(F.array().cast("array<int>").alias("picked"), F.lit(0).alias("used"))

    def step(a: Column, x: Column) -> Column:
        need = x["n"] + F.when(F.size(a["picked"]) > 0, 1).otherwise(0)
        return F.when(a["used"] + need <= budget, F.struct(F.concat(a["picked"], F.array(x["p"])).alias("picked"), (a["used"] + need).alias("used"))).otherwise(a)

    return F.sort_array(F.aggregate(order, start, step, lambda a: a["picked"]))
