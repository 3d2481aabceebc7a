"""Nearest vectors against every pair, with copies, ties and slabs smaller than a block."""

import numpy as np

from tessera.operators import retrieval as R


def test_blocks_and_slabs_equal_every_pair(spark, monkeypatch):
    monkeypatch.setattr(R, "SLAB", 50)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8)).astype(np.float32).round(2)
    vectors[100:160] = vectors[0]  # copies: ties go to smaller keys
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (None, [1.0] * 8)], "id long, v array<float>")
    score = np.round(vectors.astype(float) @ vectors.astype(float).T, 6)
    want = []
    for i, row in enumerate(score):
        near = [j for j in np.lexsort((np.arange(len(row)), -row)) if j != i][:3]
        want += [(i, int(j), float(row[j]), n + 1) for n, j in enumerate(near)]
    for block in (None, 300):
        assert sorted(map(tuple, R.dense_top_k(df, df, "id", "v", 3, block).collect()), key=lambda r: (r[0], r[3])) == want


def test_of_a_row_of_scores_few_are_sorted():
    score = np.random.default_rng(1).normal(size=(40, 4096))
    i, j, s = R._largest(score, 4)
    assert len(i) < 40 * 40 and all(set(np.argsort(-row)[:4]) <= set(j[i == n]) for n, row in enumerate(score)) and (score[i, j] == s).all()
