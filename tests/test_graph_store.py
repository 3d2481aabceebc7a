"""Loads are exact, replace what was there, and leave it alone where they fail."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import graph_store as S


def tables(spark, n, extra=()):
    nodes = spark.createDataFrame([(f"n{i}", "PART" if i % 2 else "WHOLE", f'{{"i": {i}}}') for i in range(n)], "id string, type string, properties string").repartition(3)
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "NEXT", None) for i in range(n - 1)] + list(extra), "id string, source string, target string, type string, properties string").repartition(2)
    return nodes, edges


def stored(spark, path):
    return sorted(map(tuple, S.read_graph(spark, path).collect()), key=repr)


def test_load_replace_and_fail(spark, tmp_path):
    path = str(tmp_path)
    assert stored(spark, path) == []
    nodes, edges = tables(spark, 40)
    S.load_graph(spark, nodes, edges, path)
    first = stored(spark, path)
    want = [("node", r["id"], r["type"], None, None, r["properties"]) for r in nodes.collect()] + [("edge", r["id"], r["type"], r["source"], r["target"], None) for r in edges.collect()]
    assert first == sorted(want, key=repr)
    builds = lambda: [x for x in os.listdir(tmp_path / "graph") if x.startswith("build-")]
    one = builds()
    assert len(one) == 1
    # a task that fails, a count that differs: the old graph stays, and nothing else
    broken = nodes.withColumn("properties", F.when(F.col("id") == "n7", F.raise_error(F.lit("lost"))).otherwise(F.col("properties")))
    with pytest.raises(Exception, match="lost"):
        S.load_graph(spark, broken, edges, path)
    rows = nodes.select(F.lit("node").alias("kind"), "id", "type", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "properties")
    with pytest.raises(Exception, match="expected"):
        rows.write.format("graph_store").option("path", path).option("expected_nodes", "41").mode("overwrite").save()
    assert stored(spark, path) == first and set(one) <= set(builds())
    S.load_graph(spark, *tables(spark, 5), path)
    assert len(stored(spark, path)) == 9 and len(builds()) == 1 and builds() != one


def test_unsound_graphs_are_refused(spark, tmp_path):
    nodes, edges = tables(spark, 4, [("e0", "n0", "n9", "next", None), (None, "n0", "n1", "NEXT", None)])
    assert {r["problem"]: r["n"] for r in S.graph_problems(nodes, edges).collect()} == {"DANGLING_EDGE": 1, "REPEATED_EDGE": 1, "EDGE_TYPE": 1, "EDGE_WITHOUT_ID": 1}
    with pytest.raises(ValueError, match="DANGLING_EDGE"):
        S.load_graph(spark, nodes, edges, str(tmp_path))
    assert S.graph_problems(*tables(spark, 4)).count() == 0 and not os.listdir(tmp_path)
