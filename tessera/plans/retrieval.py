"""Retrieval queries over documents, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as V
from tessera.operators import lexical as X
from tessera.operators import retrieval as R
from tessera.operators.evidence import occurrences
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources.scratch import store

_BM25 = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0) AS w FROM documents),
stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0)) AS term FROM benchmark),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM tok)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), stat GROUP BY item_id, doc_id),
lexical AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 30)
"""

_DENSE = """
e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= {k})
"""


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", k)


def _neighbours(spark: SparkSession, sf_dir: str, k: int, asked: DataFrame | None = None) -> DataFrame:
    """Nearest vectors of all rows, or of those whose id is in the column item_id of asked."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows if asked is None else rows.join(asked, F.col("vec_id") == F.col("item_id"), "left_semi")
    return R.dense_top_k(queries, rows, "vec_id", "embedding", k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lexical WHERE rank <= 10")
def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR3, SR4, TK2: the ten best documents for each benchmark passage."""
    return _lexical(spark, sf_dir, 10).select("item_id", "doc_id", "score", "rank")


def _bounded(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The lexical channel from a stored index, with bounds."""
    asked = X.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    index = X.lexical_index(table(spark, sf_dir, "documents"), "doc_id", "text", asked)
    return X.bounded_top_k(index, asked, "item_id", "doc_id", k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lexical WHERE rank <= 10")
def q_bm25_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK2, SR3, SR4: the same ten, from a stored index by impact, skipping what can't be among them."""
    return _bounded(spark, sf_dir, 10)


@query(f"WITH {_DENSE.format(k=3)} SELECT query_id, neighbour_id, score, rank FROM near")
def q_knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR5, TK3, WN4: three nearest vectors of every vector."""
    return _neighbours(spark, sf_dir, 3).select("query_id", "neighbour_id", "score", "rank")


@query(f"WITH {_DENSE.format(k=3)} SELECT query_id AS source, neighbour_id AS target, score FROM near WHERE query_id < neighbour_id")
def q_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19, SR11: kept where the smaller key lists the larger."""
    return R.knn_edges(_neighbours(spark, sf_dir, 3))


_FUSED = f"""
{_BM25}, {_DENSE.format(k=30)},
chan AS (SELECT item_id, doc_id, rank, 'bm25' AS name, 0 AS ord FROM lexical
  UNION ALL SELECT query_id, neighbour_id, rank, 'dense', 1 FROM near WHERE query_id IN (SELECT item_id FROM benchmark)),
fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, string_agg(name, ',' ORDER BY name) AS methods, arg_max(name, ord) AS method
  FROM chan GROUP BY item_id, doc_id),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS INTEGER) AS fused_rank FROM fused) WHERE fused_rank <= 30)
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id").distinct()
    dense = _neighbours(spark, sf_dir, 30, asked).select(F.col("query_id").alias("item_id"), F.col("neighbour_id").alias("doc_id"), "rank")
    return R.reciprocal_rank_fusion([("bm25", _lexical(spark, sf_dir, 30)), ("dense", dense)], ["item_id"], "doc_id", 30)


@query(f"WITH {_FUSED} SELECT item_id, doc_id, rrf, methods, method, fused_rank FROM best")
def q_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, SR8, AG7: lexical and dense channels fused; the last channel gives the payload."""
    return _fused(spark, sf_dir)


@query(f"""WITH {_FUSED}, items AS (
  SELECT b.item_id, b.doc_id, b.rrf, coalesce(0.5 * greatest(0, least(100, 5 * CAST(regexp_extract(d.source, '[0-9]+') AS INTEGER))) / 100
    + 0.2 * CAST(d.lang = 'en' AS INTEGER) + 0.15 * CAST(l.doc_id IS NOT NULL AS INTEGER) + 0.15 * coalesce(l.quality, 0), 0) AS authority,
    coalesce(l.quality = 1, false) AS dated
  FROM best b LEFT JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
f AS (SELECT *, round(0.75 * rrf / max(abs(rrf)) OVER (PARTITION BY item_id) + 0.2 * authority + 0.05 * CAST(dated AS INTEGER), 6) AS final FROM items)
SELECT item_id, doc_id, final, CAST(row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS INTEGER) AS final_rank FROM f""")
def q_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, AG11, SR9: fused items reranked by relevance, authority and reviewed dates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    items = _fused(spark, sf_dir).join(docs, "doc_id", "left").join(labels, "doc_id", "left")
    rank = 5 * F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)")
    authority = F.coalesce(R.authority_score(rank, F.col("lang") == "en", F.coalesce("labelled", F.lit(False)), F.col("quality") == 1), F.lit(0.0))
    return R.rerank(items, ["item_id"], "doc_id", "rrf", authority, F.col("quality") == 1).select("item_id", "doc_id", "final", "final_rank")


@query(r"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}', 0)) AS w FROM benchmark),
qt AS (SELECT item_id, len(w) AS n_terms, unnest(w) AS term FROM q),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}', 0)) AS term FROM documents),
s AS (SELECT item_id, doc_id, n_terms, count(*) AS overlap FROM d JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT item_id, doc_id, overlap, round(overlap / greatest(1, n_terms), 6) AS score FROM s)
SELECT item_id, doc_id, overlap, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 10""")
def q_case_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR7, FN16: documents by the share of a passage's words they hold."""
    rows = R.overlap_channel(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return R.top_per(rows, ["item_id"], [F.desc("score"), F.col("doc_id")], 10).select("item_id", "doc_id", "overlap", "score")


@query("""WITH refs AS (SELECT o_orderkey AS ref_id, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS l_linenumber FROM orders),
f AS (SELECT r.ref_id, l.l_orderkey * 10 + l.l_linenumber AS unit_id, l.l_quantity AS authority FROM refs r JOIN lineitem l
  ON l.l_orderkey = r.o_orderkey AND (r.l_linenumber IS NULL OR l.l_linenumber = r.l_linenumber))
SELECT ref_id, unit_id, authority, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY authority DESC, unit_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def q_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, SR6, PF12: lines by order and, where supplied, line number; five per reference."""
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.col("l_quantity").alias("authority"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1).alias("l_linenumber"))
    return R.exact_lookup(units, refs, "ref_id", ["o_orderkey", "l_linenumber"], "unit_id", "authority").select("ref_id", "unit_id", "authority", "rank")


@query("""WITH got AS (SELECT DISTINCT source, lang FROM documents), gold AS (
  SELECT d.source, list_sort(list(d.doc_id)) AS gold FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 GROUP BY d.source),
hit AS (SELECT source, list_sort(list(doc_id)) AS got FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10 GROUP BY source)
SELECT g.source, CAST(len(list_intersect(gold, got)) AS INTEGER) AS hits, CAST(len(gold) AS INTEGER) AS n_gold,
  round(len(list_intersect(gold, got)) / len(gold), 6) AS recall, round(len(list_intersect(gold, got)) / len(got), 6) AS precision
FROM gold g JOIN hit h USING (source)""")
def q_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, SR19, SE3: recall and precision at ten per source, with good labels as the gold set."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = docs.select("source", "doc_id").join(labels.filter("quality = 1").select("doc_id"), "doc_id")
    got = R.top_per(docs.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 10).select("source", "doc_id")
    return R.recall_precision(got, gold, ["source"], "doc_id")


@query("""WITH v AS (SELECT * FROM (VALUES ('flat_bm25', false, false), ('flat_hybrid', true, false), ('adaptive', true, true), ('adaptive_no_hub', true, true)) t(variant, dense, graph)),
s AS (SELECT source, avg(n_chars) AS mean_chars, median(n_chars) AS median_chars, quantile_disc(n_chars, 0.95) AS p95_chars, count(*) AS n FROM documents GROUP BY source)
SELECT variant, dense, graph, source, n, round(mean_chars, 6) AS mean_chars, median_chars, CAST(p95_chars AS DOUBLE) AS p95_chars FROM s CROSS JOIN v""")
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG14, SR20: mean, median and nearest-rank percentile per source for each of four fixed variants."""
    stats = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"), F.expr("cast(percentile_disc(0.95) within group (order by n_chars) as double)").alias("p95_chars"))
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(d).alias("dense"), F.lit(g).alias("graph")) for n, d, g in (("flat_bm25", False, False), ("flat_hybrid", True, False), ("adaptive", True, True), ("adaptive_no_hub", True, True))])
    return stats.withColumn("v", F.explode(variants)).select("v.variant", "v.dense", "v.graph", "source", "n", "mean_chars", "median_chars", "p95_chars")


@query("""WITH d AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pre FROM documents),
over AS (SELECT * FROM d WHERE pre <= 100), ok AS (SELECT o.doc_id, o.lang, o.n_chars FROM over o JOIN labels l ON o.doc_id = l.doc_id AND l.toxic = 0)
SELECT lang, doc_id, n_chars, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM ok) WHERE rank <= 5""")
def q_overfetch_filter_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK4: candidates first (max(20 k, 100)), then the filter, then the first k."""
    first = R.top_per(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 100, "pre")
    kept = first.join(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"), "doc_id")
    return R.top_per(kept, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id", "n_chars", "rank")


_TRUTH = "truth AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {_FUSED}, {_TRUTH},
knn AS (SELECT query_id AS source, neighbour_id AS target, score FROM near WHERE rank <= 3 AND query_id < neighbour_id),
deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM knn UNION ALL SELECT target FROM knn) GROUP BY node),
step AS (SELECT source, target, score FROM knn UNION ALL SELECT target, source, score FROM knn),
reached AS (SELECT item_id, target AS doc_id, rrf * greatest(s.score, 0) AS gain, 0.15::DOUBLE / 61 * degree / (SELECT max(degree) FROM deg) AS penalty
  FROM best JOIN step s ON s.source = best.doc_id JOIN deg ON deg.node = s.target WHERE fused_rank <= 10),
cand AS (SELECT 'flat_bm25' AS variant, item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM lexical
  UNION ALL SELECT v, item_id, doc_id, rrf FROM best, (VALUES ('flat_hybrid'), ('adaptive'), ('adaptive_no_hub')) t(v)
  UNION ALL SELECT 'adaptive', item_id, doc_id, gain - penalty FROM reached UNION ALL SELECT 'adaptive_no_hub', item_id, doc_id, gain FROM reached),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, item_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT variant, item_id, doc_id, round(max(score), 9) AS score FROM cand GROUP BY ALL)) WHERE rank <= 10),
listed AS (SELECT top.*, t.doc_id IS NOT NULL AS hit, d.n_chars, d.doc_id IS NOT NULL AS known FROM top LEFT JOIN truth t USING (item_id, doc_id) LEFT JOIN documents d ON d.doc_id = top.doc_id),
sizes AS (SELECT item_id, count(*) AS n_true FROM truth GROUP BY item_id),
each AS (SELECT variant, item_id, count(*) AS n, count(*) FILTER (hit) AS hits, coalesce(max(1.0::DOUBLE / rank) FILTER (hit), 0) AS rr FROM listed GROUP BY ALL),
means AS (SELECT variant, sum(hits / n_true) AS r, sum(hits / n) AS p, sum(rr) AS rr FROM each JOIN sizes USING (item_id) GROUP BY variant),
about AS (SELECT variant, count(*) FILTER (NOT known) AS fabricated, round(avg(n_chars), 6) AS evidence_chars FROM listed GROUP BY variant), q AS (SELECT count(*) AS n FROM sizes)
SELECT variant, q.n AS queries_with_truth, round(coalesce(r, 0) / q.n, 6) AS recall, round(coalesce(p, 0) / q.n, 6) AS precision, round(coalesce(rr, 0) / q.n, 6) AS reciprocal_rank, fabricated, evidence_chars
FROM about LEFT JOIN means USING (variant), q""")
def q_variant_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR19, SR20, AG15: four variants of the retrieval run over the benchmark passages, scored against the documents that
    hold them; channels are made once and shared."""
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    dense = store(_neighbours(spark, sf_dir, 30, passages.select("item_id").distinct()), "neighbours")
    dense = dense.select(F.col("query_id").alias("item_id"), F.col("neighbour_id").alias("doc_id"), "rank")
    nearest = store(_neighbours(spark, sf_dir, 3), "neighbours")
    rankings = V.variant_rankings(_bounded(spark, sf_dir, 30), dense, R.knn_edges(nearest), "item_id", "doc_id")
    truth = occurrences(docs, "doc_id", "text", passages, "item_id", "text").select("item_id", "doc_id")
    return V.variant_scores(rankings, truth, docs.select("doc_id", "n_chars"), "item_id", "doc_id", "n_chars")
