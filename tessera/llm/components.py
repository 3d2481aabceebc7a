"""Connected components of a link table, in the cluster, with lineage cut every round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task contracts at a time, as many as a file of a stored round holds.
LINKS_PER_FILE = 1 << 17
#: A node with more links than this (or than a thousandth of all, if that is more) is dealt out to several tasks.
HUB = 1000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that aren't a root, their roots): components of a few links, by least neighbours and halved paths."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[root]
        while (shorter := least[least]).tobytes() != least.tobytes():
            least = shorter
        if (least == root).all():
            break
        root = least
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of every LINKS_PER_FILE links as links (u, v) of nodes to their roots."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= 2 * LINKS_PER_FILE:
            held = [_roots(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) >= LINKS_PER_FILE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held = []
            n = sum(len(x) for x, _ in held)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(*map(np.concatenate, zip(*held)))], ["u", "v"])


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _with_least(pairs: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """pairs (u, v) and m of least (u, m, k links), of n pairs at most. A hub's links are dealt out by their other end,
    too; with the bound on what a hub is there are at most 2000 of them, so their list may be broadcast."""
    size = max(HUB, -(-n // 1000))
    hubs = least.filter(F.col("k") > size).select("u", F.ceil(F.col("k") / size).cast("int").alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    left = pairs.join(F.broadcast(hubs), "u", "left").select("u", "v", salt.alias("part"))
    parts = F.when(F.col("k") > size, F.ceil(F.col("k") / size).cast("int")).otherwise(1)
    right = least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(right, ["u", "part"]).select("u", "v", "m")


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node with a link to another one.

    Every task contracts its links to stars; what fits one file is then done. Otherwise two steps alternate until nothing
    changes: every node hands its larger neighbours to its smallest one, then its smaller neighbours, and tasks contract
    again. Minima combine before the shuffle, hubs are dealt out to several tasks; only the links move, and none of them
    reaches the driver. Links with a null end and links of a node to itself say nothing.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    first = materialize(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    n = first.count()
    files = lambda n: max(1, -(-n // LINKS_PER_FILE))
    stars = lambda pairs, n: materialize(pairs.coalesce(files(n)).mapInArrow(_contract, "u long, v long"), "links")
    pairs = stars(first, n)
    discard(first)
    before = _signature(pairs) if files(n) > 1 else (0,)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"), "least", files(before[0]))
        large = _with_least(both, low, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large", files(before[0]))
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "least", files(before[0]))
        small = _with_least(large, low2, 2 * before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_pairs = stars(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), before[0])
        discard(pairs, low, large, low2)
        pairs, after = after_pairs, _signature(after_pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
