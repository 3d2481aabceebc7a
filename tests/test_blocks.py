"""Blocks of units against blocks of queries: the rows of plain sums over all pairs, of which few leave a task."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.operators import lexical as X
from tessera.operators import retrieval as R


def plain(units, asked, k):
    """Sums over all pairs; units of one key and length count a word's number together."""
    texts = [(key, None if t is None else t.split()) for key, t in units]
    n, lengths = len(texts), [len(w) for _, w in texts if w is not None]
    tf, want = defaultdict(Counter), defaultdict(set)
    for key, words in texts:
        tf[key, len(words or [])].update(words or [])
    for q, t in asked:
        want[q].update(t.split())
    df = Counter(t for words in tf.values() for t in words)
    mean, score = sum(lengths) / len(lengths), defaultdict(float)
    for (key, length), words in tf.items():
        for q, terms in want.items():
            for t in terms & words.keys():
                score[q, key] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words[t] / (words[t] + 1.5 * (0.25 + 0.75 * length / mean))
    out = []
    for q in want:
        best = sorted((-round(s, 6), key) for (p, key), s in score.items() if p == q)[:k]
        out += [(q, key, -s, i + 1) for i, (s, key) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"CELLS": 40, "QUERIES": 3, "PAIRS": 30}, {"ASKED": 2, "PAIRS": 200}])
def test_blocks_equal_plain_sums(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(R, name, value)
    rng = random.Random(3)
    words = [f"w{i:02}" for i in range(25)]
    units = [(i, " ".join(rng.choices(words, range(25, 0, -1), k=rng.randint(1, 20)))) for i in range(60)]
    units += [(90 + i, units[0][1]) for i in range(9)] + [units[1], (2, "w00 w01"), (200, None), (201, "")]  # copies, a row twice, one key with two texts
    asked = [(q, " ".join(rng.choices(words, k=5))) for q in range(8)] + [(0, "w24 w00"), (0, "w24"), (50, "none")]
    rows, top_per = [], R.top_per
    monkeypatch.setattr(R, "top_per", lambda *x: rows.append(x[0]) or top_per(*x))
    got = R.bm25(spark.createDataFrame(units, "u long, text string"), "u", "text", spark.createDataFrame(asked, "q int, text string"), "q", "text", 4)
    assert [(q, u, pytest.approx(s, abs=2e-6), r) for q, u, s, r in sorted(map(tuple, got.collect()))] == plain(units, asked, 4)
    if not bounds:  # one block: no more than the best of each query leave it
        assert rows[0].count() == 8 * 4


@pytest.mark.parametrize("block", [10**6, 40])
def test_bounded_search_of_blocks_equals_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "QUERIES", 1024 if block > 40 else 3)
    rng = random.Random(4)
    words = [f"w{i:02}" for i in range(40)]
    units = [(f"u{i:02}", " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 20))) + f" rare{i % 9}" * (i % 3 == 0)) for i in range(80)]
    units += [(f"v{i}", units[0][1]) for i in range(9)] + [units[1], ("u02", "w00 w01")]  # copies, a row twice, one key with two texts
    asked = [(q, " ".join(rng.choices(words, k=6)) + f" rare{q}") for q in range(9)] + [(50, "none")]
    found, top_per = [], R.top_per
    monkeypatch.setattr(X, "top_per", lambda *x: found.append(x[0]) or top_per(*x))
    index = X.lexical_index(spark.createDataFrame(units, "u string, text string"), "u", "text")
    got = X.bounded_top_k(index, X.query_terms(spark.createDataFrame(asked, "q int, text string"), "q", "text"), "q", "u", 2)
    assert [(q, u, pytest.approx(s, abs=2e-6), r) for q, u, s, r in sorted(map(tuple, got.collect()))] == plain(units, asked, 2)
    assert (index.postings.filter("term is null").count() > 5) == (block == 40)  # so many blocks have units
    assert max(df.count() for df in found) <= index.blocks * 9 * 2  # a query's best of a block, not a row for each pair
