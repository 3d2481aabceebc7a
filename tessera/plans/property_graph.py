"""A property graph of documents, their sources and labels, and of conversations with their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import property_graph as P
from tessera.plans.registry import query
from tessera.session import table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = lambda kind, *c: F.concat(F.lit(kind + ":"), *[x for i, n in enumerate(c) for x in ([F.lit(":")] if i else []) + [F.col(n).cast("string")]])
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumns({"up": key("conv", "conv_id"), "id": key("turn", "conv_id", "turn")})
    nodes = [
        P.node_rows(docs, key("doc", "doc_id"), F.when(F.col("lang") == "en", "DocumentVersion").otherwise("SourceDocument"), "document", ["lang", "n_chars"]),
        P.node_rows(docs.select("source").distinct(), key("series", "source"), F.lit("PolicySeries"), "ontology", ["source"]),
        P.node_rows(labels, key("item", "doc_id"), F.lit("DiagnosticItem"), "derived", ["toxic"]),
        P.node_rows(turns.select("conv_id", "up").distinct(), F.col("up"), F.lit("Article"), "rule"),
        P.node_rows(turns, F.col("id"), F.lit("Clause"), "rule", ["turn", "role"]),
    ]
    edges = [
        P.edge_rows(docs, key("doc", "doc_id"), key("series", "source"), "BELONGS_TO_POLICY_SERIES"),
        P.edge_rows(labels, key("doc", "doc_id"), key("item", "doc_id"), "HAS_DIAGNOSTIC_ITEM", F.col("quality"), ["toxic"]),
        P.edge_rows(turns, F.col("id"), F.col("up"), "PART_OF"),
        P.sibling_edges(turns, "up", ["turn"], "id"),
    ]
    return P.property_graph(nodes, edges)


@query("""SELECT DISTINCT * FROM (
SELECT 'doc:' || doc_id AS id, CASE WHEN lang = 'en' THEN 'DocumentVersion' ELSE 'SourceDocument' END AS label, 'document' AS layer, '{' || concat_ws(',', '"lang":"' || lang || '"', '"n_chars":' || n_chars) || '}' AS properties FROM documents
UNION ALL SELECT 'series:' || source, 'PolicySeries', 'ontology', '{"source":"' || source || '"}' FROM documents UNION ALL SELECT 'item:' || doc_id, 'DiagnosticItem', 'derived', coalesce('{"toxic":' || toxic || '}', '{}') FROM labels
UNION ALL SELECT 'conv:' || conv_id, 'Article', 'rule', '{}' FROM conversations UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'Clause', 'rule', '{' || concat_ws(',', '"turn":' || turn, '"role":"' || role || '"') || '}' FROM conversations) WHERE id IS NOT NULL""")
def q_property_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR13: nodes with labels, layers and properties."""
    return _graph(spark, sf_dir)[0]


@query("""SELECT DISTINCT * FROM (SELECT 'doc:' || doc_id AS source, 'series:' || source AS target, 'BELONGS_TO_POLICY_SERIES' AS type, CAST(NULL AS DOUBLE) AS confidence, '{}' AS properties FROM documents
UNION ALL SELECT 'doc:' || doc_id, 'item:' || doc_id, 'HAS_DIAGNOSTIC_ITEM', quality::DOUBLE, coalesce('{"toxic":' || toxic || '}', '{}') FROM labels UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'conv:' || conv_id, 'PART_OF', NULL, '{}' FROM conversations
UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 'NEXT', NULL, '{}' FROM conversations) WHERE source IS NOT NULL AND target IS NOT NULL""")
def q_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR13, WN1: edges with types, confidences and properties."""
    return _graph(spark, sf_dir)[1].select("source", "target", "type", "confidence", "properties")
