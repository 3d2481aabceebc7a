"""Retrieval variants run side by side over the same stored channels, and their scores against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import degree
from tessera.operators.retrieval import reciprocal_rank_fusion, top_per
from tessera.sources.scratch import store

#: The variants by what they use.
VARIANTS = ("flat_bm25", "flat_hybrid", "adaptive", "adaptive_no_hub")
HUB_PENALTY = 0.15


def variant_rankings(lexical: DataFrame, dense: DataFrame, edges: DataFrame, query: str, unit: str, k: int = 10, seeds: int = 10, constant: int = 60) -> DataFrame:
    """variant, query, unit, score, rank: the k best units of each query by every variant.

    lexical, dense: query, unit, rank. edges: source, target, score between units. Both channels are stored once and shared.
    flat_bm25 is the lexical channel, flat_hybrid the fusion of both. adaptive adds the neighbours of each query's first
    `seeds` fused units, at the seed's score times the edge's, less a penalty that grows with the neighbour's degree;
    adaptive_no_hub has no penalty. A unit's best score counts; ties go to smaller units.
    """
    lexical = store(lexical.select(query, unit, "rank"), "lexical")
    dense = store(dense.select(query, unit, "rank"), "dense")
    fused = store(reciprocal_rank_fusion([("bm25", lexical), ("dense", dense)], [query], unit, 3 * k, constant).select(query, unit, "rrf", "fused_rank"), "fused")
    step = edges.select("source", "target", "score").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "score"))
    ends = degree(edges)
    most = ends.agg(F.max("degree")).first()[0] or 1
    penalty = HUB_PENALTY / (constant + 1) * F.col("degree") / F.lit(float(most))
    near = fused.filter(F.col("fused_rank") <= seeds).join(step.withColumnRenamed("source", unit), unit).join(ends.withColumnRenamed("node", "target"), "target")
    gain = F.col("rrf") * F.greatest(F.col("score"), F.lit(0.0))
    reached = near.select(query, F.col("target").alias(unit), gain.alias("gain"), penalty.alias("penalty"))

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        best = rows.groupBy(query, unit).agg(F.round(F.max("score"), 9).alias("score"))
        return top_per(best, [query], [F.desc("score"), F.col(unit)], k).select(F.lit(name).alias("variant"), query, unit, "score", "rank")

    flat = lexical.select(query, unit, (1.0 / (constant + F.col("rank"))).alias("score"))
    hybrid = fused.select(query, unit, F.col("rrf").alias("score"))
    out = ranked(flat, VARIANTS[0]).unionByName(ranked(hybrid, VARIANTS[1]))
    out = out.unionByName(ranked(hybrid.unionByName(reached.select(query, unit, (F.col("gain") - F.col("penalty")).alias("score"))), VARIANTS[2]))
    return out.unionByName(ranked(hybrid.unionByName(reached.select(query, unit, F.col("gain").alias("score"))), VARIANTS[3]))


def variant_scores(rankings: DataFrame, truth: DataFrame, units: DataFrame, query: str, unit: str, size: str) -> DataFrame:
    """variant, queries_with_truth, recall, precision (means over queries with a known answer), reciprocal_rank, fabricated
    (listed units that don't exist), evidence_chars (mean size of a listed unit), for every variant.

    rankings: variant, query, unit, rank; truth: query, unit (distinct); units: unit, size (unique units).
    """
    known = truth.select(query, unit).distinct()
    sizes = known.groupBy(query).agg(F.count("*").alias("n_true"))
    listed = rankings.join(known.withColumn("hit", F.lit(1)), [query, unit], "left")
    listed = store(listed.join(units.select(unit, F.col(size).alias("chars"), F.lit(1).alias("exists")), unit, "left"), "listed")
    each = listed.groupBy("variant", query).agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    joined = sizes.join(each, query)
    means = joined.groupBy("variant").agg(F.count("*").alias("answered"), F.sum(F.col("hits") / F.col("n_true")).alias("r"), F.sum(F.col("hits") / F.col("n")).alias("p"), F.sum("rr").alias("rr"))
    n_queries = sizes.count()
    about = listed.groupBy("variant").agg(F.count_if(F.col("exists").isNull()).alias("fabricated"), F.round(F.avg("chars"), 6).alias("evidence_chars"))
    out = about.join(means, "variant", "left").withColumn("queries_with_truth", F.lit(n_queries).cast("long"))
    mean = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / F.col("queries_with_truth"), 6)
    return out.select("variant", "queries_with_truth", mean("r").alias("recall"), mean("p").alias("precision"), mean("rr").alias("reciprocal_rank"), "fabricated", "evidence_chars")
