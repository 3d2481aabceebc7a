import pytest
from pyspark.sql import functions as F

from tessera.operators import property_graph as P


def test_siblings(spark):
    rows = spark.createDataFrame([("hot", i, f"h{i:04}") for i in range(500)] + [("a", 2, "x"), ("a", 2, "w"), ("b", 1, "y"), (None, 1, "n1"), (None, 2, "n2"), ("a", 3, None)], "up string, at int, id string")
    got = {(r.source, r.target) for r in P.sibling_edges(rows, "up", ["at"], "id").collect()}
    assert got == {(f"h{i:04}", f"h{i + 1:04}") for i in range(499)} | {("w", "x"), ("n1", "n2")}


def test_ids_and_clashes(spark):
    rows = spark.createDataFrame([("a", "p", 0.5), ("a", "p", 0.5), (None, "p", 1.0)], "id string, up string, sure double")
    nodes = P.node_rows(rows, F.col("id"), F.lit("Clause"), "rule", ["sure"])
    edges = P.edge_rows(rows, F.col("id"), F.col("up"), "PART_OF", F.col("sure"))
    n, e = P.property_graph([nodes], [edges, P.edge_rows(rows, F.col("id"), F.col("up"), "PART_OF")])
    assert [(r.id, r.label, r.properties) for r in n.collect()] == [("a", "Clause", '{"sure":0.5}')]
    assert sorted(str(r.confidence) for r in e.collect()) == ["0.5", "None"]
    with pytest.raises(ValueError, match="share an id"):
        P.property_graph([nodes, P.node_rows(rows, F.col("id"), F.lit("Point"), "rule")], [edges])
    n, e = P.property_graph([nodes.limit(0)], [edges.limit(0)])
    assert n.count() == e.count() == 0
