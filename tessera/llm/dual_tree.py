"""Lloyd's rounds by two trees: a cover tree over the vectors of each block, a cover tree over the centroids of each round.

A pair of nodes is pruned where no vector below the one can be nearest to a centroid below the other. Where one centroid is
left, a whole subtree goes to it without a distance to any of its vectors; pairs of leaves are compared exactly, in integers. Blocks are cut from the rows as they are read, so that nothing moves between tasks but one row of sums for each
centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Largest magnitude of a component after scaling: the squared distance of 64 components then fits a 64-bit integer.
LARGEST = 1 << 27
BLOCKS = "ids binary, vectors binary, center binary, radius binary, low binary, high binary, first binary, children binary"
#: Pairs of nodes whose distances are computed at once.
PAIRS = 1 << 14


class CoverTree:
    """Points in tree order, so that each node's points are the range low to high.

    A node's points lie within 2^level of its center, one of them; its children's centers are over 2^(level - 1) apart and
    cover its points within that. A node whose points all equal its center is a leaf. Children stand one after the other.
    """

    ARRAYS = ("center", "radius", "low", "high", "first", "children")

    def __init__(self, points: np.ndarray):
        n, norms = len(points), (points.astype(np.float64) ** 2).sum(axis=1)
        floats = points.astype(np.float64)
        order = np.empty(n, np.int64)
        nodes: list[list] = []  # center, radius, low, high, first, children

        def away(center: int, members: np.ndarray) -> np.ndarray:
            out = np.sqrt(np.maximum(0, norms[members] + norms[center] - 2 * (floats[members] @ floats[center])))
            out[out < 1e-3 * (1 + np.sqrt(norms[center]))] = 0  # told apart exactly below
            near = np.flatnonzero(out == 0)
            out[near] = np.sqrt(((points[members[near]] - points[center]) ** 2).sum(axis=1).astype(np.float64))
            return out

        def add(center: int, members: np.ndarray, distance: np.ndarray, low: int) -> tuple:
            nodes.append([center, float(distance.max(initial=0)), low, low + len(members), -1, 0])
            return len(nodes) - 1, members, distance

        front = [add(0, np.arange(n), away(0, np.arange(n)), 0)] if n else []
        while front:
            after = []
            for node, members, distance in front:
                center, radius, low = nodes[node][:3]
                if radius == 0:
                    order[low : low + len(members)] = members
                    continue
                nodes[node][4] = len(nodes)
                reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
                while len(members):
                    near = distance <= reach
                    after.append(add(center, members[near], distance[near], low))
                    low += int(near.sum())
                    members = members[~near]
                    if len(members):
                        center = int(members[0])
                        distance = away(center, members)
                nodes[node][5] = len(nodes) - nodes[node][4]
            front = after
        self.order = order
        columns = list(zip(*nodes)) or [()] * 6
        for name, values in zip(self.ARRAYS, columns):
            setattr(self, name, np.array(values, np.float64 if name == "radius" else np.int64))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.center = place[self.center]  # in tree order, as the points are kept

    @classmethod
    def stored(cls, *arrays: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        for name, values in zip(cls.ARRAYS, arrays):
            setattr(tree, name, np.frombuffer(values, np.float64 if name == "radius" else np.int64))
        return tree


def _unrolled(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _squares(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    out = np.empty(len(at_a), np.int64)
    for at in range(0, len(at_a), PAIRS):
        some = slice(at, at + PAIRS)
        apart = a[at_a[some]] - b[at_b[some]]
        out[some] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(tree: CoverTree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Each point's nearest centroid, ties to the smaller number; how many pairs of nodes were looked at.

    points: in the tree's order.
    """
    labels = np.full(len(points), -1, np.int64)
    if not len(points):
        return labels, 0
    above = CoverTree(centroids)
    below, seen = centroids[above.order], 0
    # equal centroids share a leaf, of which the smallest number counts
    number = np.array([above.order[a:b].min() for a, b in zip(above.low, above.high)])
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        seen += len(q)
        square = _squares(points, below, tree.center[q], above.center[r])
        distance = np.sqrt(square.astype(np.float64))
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        runs = np.diff(np.append(starts, len(q)))
        farthest = np.repeat(np.minimum.reduceat(distance + tree.radius[q], starts), runs)
        kept = distance - tree.radius[q] - above.radius[r] <= farthest * (1 + 1e-9) + 1e-9
        q, r, square = q[kept], r[kept], square[kept]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        runs = np.diff(np.append(starts, len(q)))
        leaves = np.minimum.reduceat(above.children[r] == 0, starts)
        done = leaves & ((runs == 1) | (tree.children[q[starts]] == 0))
        # leaf pairs: the exact order, with one pair a trivial one
        best = np.lexsort((number[r], square, q))[starts]
        for node, label in zip(q[starts[done]], number[r[best[done]]]):
            labels[tree.low[node] : tree.high[node]] = label
        open_ = np.repeat(~done, runs)
        q, r = q[open_], r[open_]
        # both nodes give way to their children; a leaf stands for itself
        split_q, split_r = tree.children[q] > 0, above.children[r] > 0
        n_q, n_r = np.where(split_q, tree.children[q], 1), np.where(split_r, above.children[r], 1)
        from_q, from_r = np.where(split_q, tree.first[q], q), np.where(split_r, above.first[r], r)
        each_q = _unrolled(from_q, n_q)
        q_next, times = np.repeat(each_q, np.repeat(n_r, n_q)), np.repeat(n_r, n_q)
        r_next = _unrolled(np.repeat(from_r, n_q), times)
        by_node = np.argsort(q_next, kind="stable")
        q, r = q_next[by_node], r_next[by_node]
    return labels, seen


def blocks(rows: DataFrame, dimension: int, size: int) -> DataFrame:
    """rows (vec_id, vec) in blocks of bounded size, each with its tree."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            ids, points = (np.concatenate(x) for x in zip(*held))
            held.clear()
            tree = CoverTree(points)
            arrays = [ids[tree.order], points[tree.order].astype(np.int32), *(getattr(tree, x) for x in tree.ARRAYS)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.int64)
            at = 0
            while at < len(ids):
                room = size - sum(len(x) for x, _ in held)
                held.append((ids[at : at + room], points[at : at + room]))
                at += room
                if sum(len(x) for x, _ in held) == size:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def _opened(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray, CoverTree]]:
    for batch in batches:
        for ids, vectors, *arrays in zip(*(x.to_pylist() for x in batch.columns)):
            yield np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int32).reshape(-1, dimension).astype(np.int64), CoverTree.stored(*arrays)


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of what is nearest, exactly; without any it stays."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for _, points, tree in _opened(batches, dimension):
            labels, _ = nearest(tree, points, centroids)
            # subtrees are ranges, so what goes to one centroid comes in long runs
            starts = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
            np.add.at(total, labels[starts], np.add.reduceat(points, starts, axis=0))
            count += np.bincount(labels, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = table.mapInArrow(run, "cluster long, n long, total array<long>").groupBy("cluster")
    rows = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dimension)]).collect()
    out = centroids.copy()
    for row in rows:
        out[row["cluster"]] = [row[f"t{i}"] // row["n"] for i in range(dimension)]
    return out


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dimension: int = 64, seed: int = 1, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every vector that takes part.

    Vectors with another number of components, null or non-finite ones, null ids, or components over 2^27 in magnitude after
    scaling (their distances don't fit a 64-bit integer) take no part. Repeated rows count each; the first centroids are the
    rows of the least hashes of `<seed>:<id>`, repeated ids in the order of their components. Equal centroids: the smaller
    number. Fewer than k vectors give as many centroids; an empty table gives no row. Other columns are ignored.
    """
    vec = F.col("vec")
    rows = df.select(common.column(id_col).cast("long").alias("vec_id"), common.column(vector_col).alias("vec")).filter("vec_id is not null and vec is not null")
    unfit = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > LARGEST))
    rows = rows.filter((F.size(vec) == dimension) & ~unfit).select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r["vec"] for r in rows.orderBy(hashed, "vec").limit(k).collect()], np.int64).reshape(-1, dimension)
    table = common.materialize(blocks(rows, dimension, block_rows), "blocks")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(table, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, tree in _opened(batches, dimension):
            labels, _ = nearest(tree, points, centroids)
            square = _squares(points, centroids, np.arange(len(points)), labels)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels.astype(np.int32)), pa.array(square)], ["vec_id", "cluster", "distance"])

    out = common.materialize(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    common.discard(table)
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = df.sparkSession.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
