"""Pairs of terms and postings are dealt out by their number, with the same scores."""

import pytest

from tessera.operators import retrieval as R


@pytest.mark.parametrize("channel", ["bm25", "overlap"])
def test_tasks_grow_with_the_pairs(spark, monkeypatch, channel):
    units = spark.createDataFrame([(i, " ".join(f"w{i * j % 17:02}a" for j in range(1, 9))) for i in range(120)], "u int, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{(q + j) % 19:02}a" for j in range(6))) for q in range(15)], "item int, text string")
    run = {"bm25": lambda: R.bm25(units, "u", "text", asked, "item", "text", 4), "overlap": lambda: R.overlap_channel(units, "u", "text", asked, "item", "text")}[channel]
    parts, dealt = [], R.dealt
    monkeypatch.setattr(R, "dealt", lambda *x: parts.append(dealt(*x)) or parts[-1])
    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(R, "PAIRS", 50)
    assert sorted(map(tuple, run().collect())) == want and want
    assert [p.rdd.getNumPartitions() > 20 for p in parts] == [False, True]
