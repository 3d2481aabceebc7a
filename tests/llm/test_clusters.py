"""Dual-tree Lloyd against every distance."""

import hashlib

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.dual_tree import CoverTree, clusters, nearest


def lloyd(rows, k=16, rounds=3):
    """Rows (id, integer components) by brute force, in Python's integers."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assigned():
        out = []
        for _, v in rows:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = [c for c, _ in assigned()]
        for c in set(of):
            own = [v for (_, v), x in zip(rows, of) if x == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    last = assigned()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sum(e for b, e in last if b == c), sum(e for _, e in last), shas[c]) for (i, _), (c, d) in zip(rows, last))


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n, k, d, spread = rng.integers(1, 200), rng.integers(1, 20), rng.integers(1, 6), int(rng.integers(1, 200))
        points = rng.integers(-spread, spread + 1, (n, d))
        centroids = points[rng.integers(0, n, k)] + rng.integers(0, 2, (k, 1))
        tree = CoverTree(points)
        points = points[tree.order]
        labels, _ = nearest(tree, points, centroids)
        assert (labels == ((points[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)).all()
        for i in np.flatnonzero(tree.children):
            own = np.arange(tree.first[i], tree.first[i] + tree.children[i])
            reach = 2.0 ** (np.ceil(np.log2(tree.radius[i])) - 1)
            apart = np.sqrt(((points[tree.center[own]][:, None] - points[tree.center[own]]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(own))
            assert tree.radius[own].max() <= reach + 1e-9 and apart.min() > reach - 1e-9
            assert (tree.high - tree.low)[own].sum() == tree.high[i] - tree.low[i]


def test_close_groups_are_assigned_whole():
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (8, 16))
    points = np.repeat(centers, 200, axis=0) + rng.integers(-3, 4, (1600, 16))
    tree = CoverTree(points)
    labels, seen = nearest(tree, points[tree.order], centers)
    assert (labels == (np.arange(1600) // 200)[tree.order]).all() and seen < 1600 * 8 / 10


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [int(np.floor(64 * float(x))) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_clusters(spark, sf).collect())) == lloyd(rows)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_odd_rows(spark, block):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(60)] + [(5, [0.5] * 64), (5, [0.25] * 64), (70, [0.5] * 64), (71, [0.5] * 64), (-3, [-0.01] * 64)]
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (6, [None] + [1.0] * 63), (7, [float("nan")] * 64), (8, [float("inf")] * 64), (None, [1.0] * 64), (9, [1e300] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, cluster string, vec int").repartition(4)
    want = lloyd([(i, [int(np.floor(64 * x)) for x in v]) for i, v in good])
    assert sorted(map(tuple, clusters(df, block_rows=block).collect())) == want
    few = spark.createDataFrame(good[:5], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, clusters(few).collect())) == lloyd([(i, [int(np.floor(64 * x)) for x in v]) for i, v in good[:5]])
    assert clusters(df.limit(0)).count() == 0
