"""Ends of edges against their nodes: counts equal those of the rows one by one, and little is shuffled for them."""

from collections import Counter

import pytest

from tessera.operators import graph as G
from tessera.plans import graph as plans
from tests.conftest import SF

#: Loops, repeated and unknown ends, nulls; nodes that come twice and one without an id.
EDGES = [("a", "b", "X"), ("a", "b", "X"), ("a", "a", "Y"), ("a", "gone", "X"), ("gone", "a", None), ("gone", "gone", "Y"), (None, "a", "X"), ("a", None, "X"), (None, None, None), ("b", "lost", "X"), ("a", "b", None), ("", "b", "Z")]
NODES = ["a", "a", "b", None, "", "alone"]


def tables(spark, edges=EDGES, nodes=NODES):
    e = spark.createDataFrame(edges, "source string, target string, type string").repartition(3)
    return e, spark.createDataFrame([(x,) for x in nodes], "id string").repartition(2)


@pytest.fixture
def large(spark):
    """As for large tables: nothing is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("nodes", [NODES, ["a"], [None]])
def test_dangling_ends_are_counted(spark, nodes):
    edges, ids = tables(spark, nodes=nodes)
    known = {x for x in nodes if x is not None}
    ends = [(node, end) for s, t, _ in EDGES for node, end in ((s, "source"), (t, "target")) if node not in known]
    got = G.dangling(edges, ids, "id", counted=True)
    assert got.columns == ["node", "end", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*k, n) for k, n in Counter(ends).items()), key=repr)
    assert sorted(((r["node"], r["end"]) for r in G.dangling(edges, ids, "id").collect()), key=repr) == sorted(ends, key=repr)
    assert G.dangling(edges.limit(0), ids, "id", counted=True).count() == 0


def test_targets_are_counted_before_they_are_shuffled(large):
    lines = plans.q_dangling(large, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    shuffled = [(x, lines[i + 1]) for i, x in enumerate(lines) if "Exchange hashpartitioning(target" in x or "Exchange hashpartitioning(node" in x]
    assert len(shuffled) == 2 and sum("partial_count" in below for _, below in shuffled) == 1
    # the nodes aren't sorted for each part of the edges
    assert sum("SortMergeJoin" in x for x in lines) == 2
