"""Bounded search against scoring everything."""

import random

import pytest

from tessera.operators import lexical as X
from tessera.operators import retrieval as R


def corpus(spark, seed, n=150):
    """Words of Zipf's frequencies, copies, empty texts."""
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(n)]
    texts += [texts[0]] * 5 + ["", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = [" ".join(rng.choices(words, weights, k=rng.randint(1, 12))) for _ in range(12)] + ["w000", "unknown", "", "w119 w000 w001"]
    return docs, spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")


@pytest.mark.parametrize("k", [1, 10])
def test_same_rows_as_scoring_everything(spark, k):
    docs, asked = corpus(spark, k)
    index = X.lexical_index(docs, "doc_id", "text")
    terms = X.query_terms(asked, "item_id", "text")
    want = R.bm25(docs, "doc_id", "text", asked, "item_id", "text", k).select("item_id", "doc_id", "score", "rank")
    got = X.bounded_top_k(index, terms, "item_id", "doc_id", k).select("item_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = X.bounded_top_k(index, terms.filter("item_id = 15"), "item_id", "doc_id", k)  # the same index again
    assert {r["item_id"] for r in one.collect()} == {15}
    odd = docs.unionByName(spark.createDataFrame([(None, "w000"), (900, None)], docs.schema))
    more = X.bounded_top_k(X.lexical_index(odd, "doc_id", "text"), terms, "item_id", "doc_id", k)
    assert not {None, 900} & {r["doc_id"] for r in more.collect()} and more.count() == got.count()
    none = X.lexical_index(docs.limit(0), "doc_id", "text")
    assert X.bounded_top_k(none, terms, "item_id", "doc_id", k).count() == 0


def test_common_words_are_skipped(spark):
    """Every document has the common words, few have the rare one: with it in the question, most postings aren't scored."""
    rows = [(i, "the of and in " * (1 + i % 7) + (f"rare{i % 40} " if i < 400 else "") + f"own{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the of and in rare{q}") for q in range(8)], "item_id long, text string")
    index, counts = X.lexical_index(docs, "doc_id", "text"), {}
    got = X.bounded_top_k(index, X.query_terms(asked, "item_id", "text"), "item_id", "doc_id", 5, counts)
    want = R.bm25(docs, "doc_id", "text", asked, "item_id", "text", 5).select("item_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert counts["all"] == 8 * (4 * 4000 + 10) and counts["scored"] < counts["all"] / 50
