"""Communities of a weighted graph by modularity: local moves, then contraction, in rounds.

Modularity compares what lies inside communities with what chance would put there. A round lets nodes move to the
neighbouring community that gains most, then makes each community one node of a smaller graph. Weights are whole numbers,
so that sums and comparisons are exact and don't depend on the order of rows. Every step is joins and aggregates over
stored tables by a shuffle; nothing is broadcast. The facts of keys that hold a large share of all rows, hubs and large
communities, are dealt out in copies, their rows to one copy each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import discard, store

#: Weights are rounded to this fraction.
SCALE = 1_000_000
#: A key's facts are dealt out in COPIES from this share of all rows on, if it has MANY rows; there are no more than so many of them.
SHARES = 1000
MANY = 10_000
COPIES = 32


def frequent(counted: DataFrame, key: str, n: str, rows: int) -> list:
    """The keys (unique) that hold so large a share of the rows that one task mustn't take them; `n` counts a key's rows."""
    least = max(rows / SHARES, MANY)
    return [r[0] for r in counted.filter(F.col(n) > least).select(key).collect()] if rows > least else []


def lookup(rows: DataFrame, facts: DataFrame, key: str, often: list, spread: str) -> DataFrame:
    """rows with the columns of facts (unique `key`), null where it lacks the key. The facts of keys in `often` meet their rows
    in copies, to which rows are dealt by the column `spread`."""
    rest = [c for c in facts.columns if c != key]
    facts = facts.withColumnRenamed(key, "__key")
    if not often:
        return rows.join(facts.hint("merge"), F.col(key) == F.col("__key"), "left").select(*rows.columns, *rest)
    copies = F.when(F.col("__key").isin(often), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    at = F.when(F.col(key).isin(often), F.pmod(F.xxhash64(spread), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))
    facts = facts.withColumn("__copy", F.explode(copies)).hint("merge")
    return rows.withColumn("__at", at).join(facts, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__copy")), "left").select(*rows.columns, *rest)


def _start(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stored table, links (u, v, w) out of it (u, v, w), both ways, and nodes (u, loop, k, n): own weight, all weight, number of links."""
    weight = F.round(F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)) * SCALE).cast("decimal(38,0)")
    known = edges.filter("source is not null and target is not null").select(F.col("source").cast("string").alias("u"), F.col("target").cast("string").alias("v"), weight.alias("w"))
    ways = F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    both = store(known.select(ways.alias("e")).select("e.*").groupBy("u", "v").agg(F.sum("w").cast("decimal(38,0)").alias("w")), "links")
    return _nodes(both)


def _nodes(both: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    loop = F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(F.lit(0))).cast("decimal(38,0)")
    nodes = store(both.groupBy("u").agg(loop.alias("loop"), F.sum("w").cast("decimal(38,0)").alias("k"), F.count("*").alias("n")), "nodes")
    return both, both.filter("u <> v"), nodes


def _turn(links: DataFrame, nodes: DataFrame, labels: DataFrame, hubs: list, large: list, total: int, turn: int) -> DataFrame:
    """u, k, c, own (weight into c, loop included), to: the community that each node is in and the one it moves to. Half of
    the nodes may move in a turn, another half in the next. `hubs` and `large`: frequent nodes and communities."""
    named = labels.join(nodes.hint("merge"), "u").select("u", "c", "k", "loop")
    sizes = named.groupBy("c").agg(F.sum("k").cast("decimal(38,0)").alias("mass"), F.count("*").alias("members"))
    whose = named.select(F.col("u").alias("v"), F.col("c").alias("near"))
    seen = lookup(links, whose, "v", hubs, "u")
    into = seen.groupBy("u", "near").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    # a node's own community counts, also without a link into it
    mine = named.select("u", F.col("c").alias("near"), F.lit(0).cast("decimal(38,0)").alias("w"))
    into = into.unionByName(mine).groupBy("u", "near").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    weighed = lookup(into, sizes.withColumnRenamed("c", "near"), "near", large, "u").join(named.hint("merge"), "u")
    here = F.col("near") == F.col("c")
    others = F.col("mass") - F.when(here, F.col("k")).otherwise(F.lit(0))
    gain = (F.col("w") * F.lit(total).cast("decimal(38,0)")).cast("decimal(38,0)") - (F.col("k") * others).cast("decimal(38,0)")
    weighed = weighed.select("u", "k", "c", "loop", "w", "near", "members", gain.cast("decimal(38,0)").alias("gain"), here.alias("here"))
    best = F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("here")).alias("away"), "near", "members"))
    mine = lambda c: F.max(F.when(F.col("here"), F.col(c)))
    picked = weighed.groupBy("u", "k", "c", "loop").agg(best.alias("best"), mine("w").alias("w"), mine("members").alias("members"))
    # two nodes on their own must not change places
    swap = (F.col("members") == 1) & (F.col("best.members") == 1) & (F.col("best.near") > F.col("c"))
    may = (F.pmod(F.xxhash64("u", F.lit(turn // 2)), F.lit(2)) == turn % 2) & ~swap
    return picked.select("u", "k", "c", (F.col("w") + F.col("loop")).cast("decimal(38,0)").alias("own"), F.when(may, F.col("best.near")).otherwise(F.col("c")).alias("to"))


def _score(state: DataFrame, total: int) -> tuple[float, int]:
    """Modularity of the labels c, and how many nodes are about to leave."""
    part = state.groupBy("c").agg(F.sum("own").alias("own"), F.sum("k").alias("k"), F.count_if(F.col("c") != F.col("to")).alias("moves"))
    share = lambda c: F.col(c).cast("double") / float(total)
    row = part.agg(F.sum(share("own") - share("k") * share("k")).alias("q"), F.sum("moves").alias("moves")).first()
    return row["q"] or 0.0, row["moves"] or 0


def modularity_communities(edges: DataFrame, turns: int = 30, levels: int = 20, least_gain: float = 1e-6) -> DataFrame:
    """node, community: the communities of an undirected graph with edges source, target, weight; a community bears its
    smallest node's name. Repeated edges add up, negative and null weights count 0, loops count for their node. Nodes are
    the ends of edges with a name; an empty table gives no row.

    A level takes turns until nothing moves or modularity gains less than `least_gain`, and keeps the best turn's labels; the
    next level begins with those as nodes, until they don't merge any more.
    """
    whole, links, nodes = _start(edges)
    total, n_links, n_nodes = nodes.agg(F.sum("k"), F.sum("n"), F.count("*")).first()
    of = nodes.select(F.col("u").alias("node"), F.col("u").alias("c"))
    for _ in range(levels if total else 0):
        turned: list[DataFrame] = []
        hubs, large = frequent(nodes, "u", "n", n_links), []
        labels, kept, best, quiet, still = nodes.select("u", F.col("u").alias("c")), None, None, 0, 0
        for turn in range(turns):
            state = store(_turn(links, nodes, labels, hubs, large, int(total), turn), "turn")
            turned.append(state)
            q, moves = _score(state, int(total))
            quiet = 0 if best is None or q > best + least_gain else quiet + 1
            still = 0 if moves else still + 1
            if best is None or q > best:
                kept, best = state, q
            labels = state.select("u", F.col("to").alias("c"))
            large = frequent(labels.groupBy("c").agg(F.count("*").alias("members")), "c", "members", n_nodes)
            discard(*[t for t in turned if t is not kept and t is not state])
            if quiet >= 4 or still >= 2:
                break
        names = kept.select("u", "c")
        merged = store(of.join(names.withColumnRenamed("u", "inner").withColumnRenamed("c", "outer").hint("merge"), F.col("c") == F.col("inner")).select("node", F.col("outer").alias("c")), "communities")
        n_after = names.select("c").distinct().count()
        if n_after == n_nodes:
            break
        discard(*([of] if hasattr(of, "_scratch") else []))
        of = merged
        ends = names.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        half = lookup(links, ends, "v", hubs, "u").select("u", "cv", "w")
        outer = half.groupBy("u", "cv").agg(F.sum("w").cast("decimal(38,0)").alias("w")).join(names.hint("merge"), "u")
        inner = nodes.join(names.hint("merge"), "u").select(F.col("c").alias("u"), F.col("c").alias("v"), F.col("loop").alias("w"))
        both = outer.select(F.col("c").alias("u"), F.col("cv").alias("v"), "w").unionByName(inner).groupBy("u", "v").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
        before = whole, nodes, *turned
        whole, links, nodes = _nodes(store(both, "links"))
        discard(*before)
        n_links, n_nodes = nodes.agg(F.sum("n"), F.count("*")).first()
    first = of.groupBy("c").agg(F.min("node").alias("community"), F.count("*").alias("members"))
    return lookup(of, first, "c", frequent(first, "c", "members", of.count()), "node").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """The modularity of a partition (node, community) of such a graph."""
    _, links, nodes = _start(edges)
    total = nodes.agg(F.sum("k")).first()[0]
    if not total:
        return 0.0
    of = communities.select(F.col("node").alias("u"), F.col("community").alias("c"))
    inside = links.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").filter("c = cv").groupBy("c").agg(F.sum("w").alias("w"))
    mass = nodes.join(of, "u").groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(inside, "c", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") / float(total)
    return mass.agg(F.sum(share("w") + share("loop") - share("k") * share("k"))).first()[0]
