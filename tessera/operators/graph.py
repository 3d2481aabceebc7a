"""Property-graph tables: node and edge builders, degrees, gates, bounded expansion, chains and communities.

Loops run on the driver over a bounded number of rounds; every round's table is stored in the shared folder, which cuts
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import discard, store


def next_edges(rows: DataFrame, parent: list[str], order: list[str], key: str) -> DataFrame:
    """source, target: consecutive siblings."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return rows.select(F.col(key).alias("source"), F.lead(key).over(w).alias("target")).filter("target is not null")


def edge_rows(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return rows.select(source.cast("string").alias("source"), target.cast("string").alias("target"), F.lit(kind).alias("type"))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: ends counted, a loop twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame, key: str, counted: bool = False) -> DataFrame:
    """Edge ends that aren't nodes. `counted`: as node, end, n, how many there are; targets, which many edges share, are counted
    before the join, so that what is shuffled of them is a row for each node and task."""
    if not counted:
        ends = edges.select("source", "target", "type", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("node")), F.struct(F.lit("target").alias("end"), F.col("target").alias("node")))).alias("e"))
        return ends.select("source", "target", "type", "e.end", "e.node").join(nodes.select(F.col(key).alias("node")), "node", "left_anti")
    ids = nodes.select(F.col(key).alias("__node"))
    # an anti join would be pushed into every part of a union of edges, and the nodes read and sorted for each
    absent = lambda rows: rows.join(ids, F.col("node") == F.col("__node"), "left").filter("__node is null")
    sources = absent(edges.select(F.col("source").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    targets = absent(edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")))
    return sources.select("node", F.lit("source").alias("end"), "n").unionByName(targets.select("node", F.lit("target").alias("end"), "n"))


def with_both_ends(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select(F.col(key).alias("__node"))
    out = edges.join(ids, F.col("source") == F.col("__node"), "left_semi")
    return out.join(ids, F.col("target") == F.col("__node"), "left_semi")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys on more than one row; null keys don't count."""
    present = rows.filter(" and ".join(f"`{k}` is not null" for k in key))
    return present.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "type").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type"))


def expand(seeds: DataFrame, edges: DataFrame, score: Column, rounds: int, max_nodes: int, degrees: DataFrame | None = None) -> DataFrame:
    """node, round, parent, score: best-first expansion in rounds, each seed group within max_nodes new nodes a round.

    seeds: seed, node. `score` may use type and degree of the target. Ties go to smaller nodes; a visited node is never
    entered again. Budgets are counts, so results don't depend on the clock.
    """
    step = both_ways(edges)
    if degrees is not None:
        step = step.join(degrees.withColumnRenamed("node", "target"), "target", "left")
    # a node's best edges: of them at most `max_nodes` new ones are kept, and a seed has visited its `starts` and max_nodes a
    # round before; so whatever a hub has beyond `room` never enters
    starts = seeds.groupBy("seed").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    room = lambda turn: starts + turn * max_nodes
    step = step.groupBy("source", "target").agg(F.max(F.round(score, 6)).alias("score"))
    best_of_node = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    step = store(step.withColumn("n", F.row_number().over(best_of_node)).filter(F.col("n") <= room(rounds)), "steps")
    visited = store(seeds.select("seed", "node", F.lit(0).alias("round"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("score")), "expand")
    for turn in range(1, rounds + 1):
        front = visited.filter(F.col("round") == turn - 1).select("seed", F.col("node").alias("source"))
        near = step.filter(F.col("n") <= room(turn)).drop("n")
        if turn > 1 or starts > 1:
            # a node with `room` edges has enough new ones itself: what is worse than its last can't enter from other nodes
            last = step.filter(F.col("n") == room(turn)).select("source", F.col("score").alias("last"))
            front = front.join(last, "source", "left").withColumn("floor", F.max("last").over(Window.partitionBy("seed"))).drop("last")
            reached = front.join(near, "source").filter("floor is null or score >= floor").drop("floor")
        else:
            reached = front.join(near, "source")
        # a seed's rows come together once: what it has seen, its best steps and their order need no other shuffle
        seen = visited.select("seed", F.col("node").alias("target"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("seen"))
        rows = reached.select("seed", "target", "source", "score", F.lit(False).alias("seen")).unionByName(seen).repartition("seed")
        best = rows.groupBy("seed", "target").agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), "source")).alias("parent"), F.max("seen").alias("seen"))
        order = Window.partitionBy("seed").orderBy(F.desc("score"), "target")
        fresh = best.filter("not seen").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_nodes)
        new = fresh.select("seed", F.col("target").alias("node"), F.lit(turn).alias("round"), "parent", "score")
        before, visited = visited, store(visited.unionByName(new), "expand")
        discard(before)
    discard(step)
    return visited


def descendants(rows: DataFrame, key: str, parent: str, roots: DataFrame) -> DataFrame:
    """Keys of roots and of everything below them, however deep; a cycle is walked once."""
    links = rows.select(key, parent).filter(F.col(key).isNotNull() & F.col(parent).isNotNull())
    found = store(roots.select(key).distinct(), "descendants")
    level = found
    while not level.isEmpty():
        below = links.join(level.select(F.col(key).alias(parent)), parent, "left_semi").select(key).distinct()
        above, level = level, store(below.join(found, key, "left_anti"), "descendants")
        before, found = found, store(found.unionByName(level), "descendants")
        discard(above, before)
    return found


def breadcrumbs(rows: DataFrame, key: str, parent: str, label: str, separator: str = " > ") -> DataFrame:
    """key, breadcrumb, depth: labels from the root down. Raises where ancestors form a cycle."""
    out = rows.select(F.col(key), F.col(label).alias("breadcrumb"), F.col(parent).alias("up"), F.lit(0).alias("depth"))
    above = rows.select(F.col(key).alias("up"), F.col(label).alias("up_label"), F.col(parent).alias("up_up"))
    done, open_, seen = out.filter("up is null"), out.filter("up is not null"), -1
    while True:
        left = open_.count()
        if not left:
            return done.select(key, "breadcrumb", "depth")
        if left == seen and open_.filter(F.col("up") == F.col(key)).count():
            raise ValueError(f"ancestors of {left} rows form a cycle")
        seen = left
        step = open_.join(above, "up", "left").select(
            key,
            F.when(F.col("up_label").isNotNull(), F.concat_ws(separator, "up_label", "breadcrumb")).otherwise(F.col("breadcrumb")).alias("breadcrumb"),
            F.col("up_up").alias("up"),
            (F.col("depth") + F.col("up_label").isNotNull().cast("int")).alias("depth"),
        )
        step = store(step, "breadcrumbs")
        done, open_ = done.unionByName(step.filter("up is null")), step.filter("up is not null")


def communities(edges: DataFrame) -> DataFrame:
    """node, community: label propagation to the smallest label, that is connected components.

    A deterministic stand-in for modularity clustering, which Spark doesn't have; the result is a coarser partition.
    """
    both = both_ways(edges.select(F.col("source"), F.col("target"), F.lit("").alias("type"))).select("source", "target").distinct()
    both = store(both, "communities")
    labels = store(both.select(F.col("source").alias("node")).distinct().withColumn("community", F.col("node")), "communities")
    while True:
        heard = both.join(labels, both["target"] == labels["node"]).groupBy("source").agg(F.min("community").alias("heard"))
        moved = labels.join(heard, labels["node"] == heard["source"], "left").select("node", F.least("community", F.coalesce("heard", "community")).alias("community"))
        # jump to the label of one's label, which halves long chains
        up = moved.select(F.col("node").alias("c"), F.col("community").alias("cc"))
        moved = store(moved.join(up, moved["community"] == up["c"], "left").select("node", F.least("community", F.coalesce("cc", "community")).alias("community")), "communities")
        same = moved.join(labels.withColumnRenamed("community", "before"), "node").filter("community <> before").isEmpty()
        before, labels = labels, moved
        discard(before)
        if same:
            break
    discard(both)
    return labels
