"""Joins, temporal selection, aggregates, ordered operators and set operations over the star schema and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as L
from tessera.operators import temporal as T
from tessera.operators.intervals import overlap_join, prefix_sum
from tessera.plans.registry import query
from tessera.session import table

AS_OF = "1996-06-30"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions: each holds until the next one."""
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("identity"), F.col("o_orderkey").alias("version_id"), "day", F.col("o_orderstatus").alias("status"))
    return T.intervals_from_events(rows, ["identity"], ["day", "version_id"], "day")


_VERSIONS = """v AS (SELECT o_custkey AS identity, o_orderkey AS version_id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS valid_from,
  lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS valid_to FROM orders)"""


@query(f"""WITH {_VERSIONS} SELECT identity, count(DISTINCT version_id) AS n_versions, min(version_id) AS version_id FROM v
WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{AS_OF}') GROUP BY identity""")
def q_asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10, PF5: the version of each identity that holds at a date."""
    return T.versions_at(_versions(spark, sf_dir), ["identity"], F.lit(AS_OF).cast("date"))


@query(f"""WITH {_VERSIONS}, w AS (SELECT identity, version_id, valid_from, CASE WHEN status = 'F' THEN valid_to + INTERVAL 10 DAY ELSE valid_to END AS valid_to FROM v),
n AS (SELECT *, lead(valid_from) OVER (PARTITION BY identity ORDER BY valid_from, version_id) AS next_from, lead(version_id) OVER (PARTITION BY identity ORDER BY valid_from, version_id) AS next_version FROM w)
SELECT identity, version_id, next_version FROM n WHERE next_version IS NOT NULL AND (valid_to IS NULL OR valid_to > next_from)""")
def q_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2: consecutive versions whose intervals overlap (closed orders are given ten days more)."""
    rows = _versions(spark, sf_dir).withColumn("valid_to", F.when(F.col("status") == "F", F.date_add("valid_to", 10)).otherwise(F.col("valid_to")))
    return T.overlaps(rows, ["identity"], ["valid_from", "version_id"]).select("identity", "version_id", "next_version")


@query(f"""WITH {_VERSIONS}, i AS (SELECT *, status <> 'P' AS provision_verified, identity % 3 <> 0 AS temporal_verified,
  CASE WHEN identity % 7 <> 0 THEN DATE '{AS_OF}' END AS day FROM v),
f AS (SELECT *, provision_verified OR temporal_verified AS usable, valid_from <= day AND (valid_to IS NULL OR day < valid_to) AS holds FROM i)
SELECT version_id, coalesce(day IS NULL OR (usable AND holds), false) AS kept,
  CASE WHEN day IS NOT NULL AND usable AND holds AND NOT provision_verified THEN 'DOCUMENT_LEVEL_TEMPORAL_FALLBACK' END AS warning FROM f""")
def q_temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF6: the non-strict filter with its fallback warning; undated questions keep everything."""
    rows = _versions(spark, sf_dir).withColumns({"provision_verified": F.col("status") != "P", "temporal_verified": F.col("identity") % 3 != 0, "day": F.when(F.col("identity") % 7 != 0, F.lit(AS_OF).cast("date"))})
    return T.temporal_filter(rows, "day", strict=False).select("version_id", "kept", "warning")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG13: counts, sums and means by two keys."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, coalesce(sum(l.l_extendedprice), 0) > 100000 AS large, count(l.l_orderkey) AS n_lines
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def q_chained_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, JN3: four left joins from the fact to its dimensions; lines are summed before they are joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("n_lines"))
    t = lambda n: table(spark, sf_dir, n)
    out = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name", (F.coalesce("total", F.lit(0.0)) > 100000).alias("large"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_type, p_size FROM part), k AS (SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS one FROM c GROUP BY ALL)
SELECT c.p_partkey, k.n AS candidate_count, CASE WHEN k.n = 1 THEN k.one END AS target FROM c JOIN k USING (p_brand, p_type, p_size)""")
def q_unique_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: a target only where exactly one row has the whole key."""
    part = table(spark, sf_dir, "part")
    keys = ["p_brand", "p_type", "p_size"]
    return L.unique_match(part.select("p_partkey", *keys), part.select(*keys, F.col("p_partkey").alias("target")), keys, "target").select("p_partkey", "candidate_count", "target")


@query("""WITH m AS (SELECT p_brand, p_size, p_partkey, max(p_size) OVER (PARTITION BY p_brand) AS top FROM part)
SELECT p_brand, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM m WHERE p_size = top GROUP BY p_brand""")
def q_tie_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: the candidate with the highest rank, null when several share it."""
    return L.best_unless_tied(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey")


def _pages(docs: DataFrame) -> DataFrame:
    """source, doc_id, s, e: each document's place in the text that a source's documents make, two characters apart."""
    rows = docs.select("source", "doc_id", F.length("text").alias("n"))
    return prefix_sum(rows, ["source"], ["doc_id"], F.col("n") + 2, "s").select("source", "doc_id", "s", (F.col("s") + F.col("n")).alias("e"))


@query("""WITH d AS (SELECT source, doc_id, length(text) AS n, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM documents),
p AS (SELECT source, doc_id, s, s + n AS e FROM d), w AS (SELECT source, CAST(5000 * unnest(range(0, 12)) AS BIGINT) AS a FROM (SELECT DISTINCT source FROM documents))
SELECT w.source, a AS window_start, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n_pages FROM w JOIN p ON p.source = w.source AND p.s < w.a + 3000 AND p.e > w.a GROUP BY 1, 2""")
def q_page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, JN8, AG8: documents of a source as pages of one text; pages that overlap fixed windows."""
    docs = table(spark, sf_dir, "documents")
    windows = docs.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(55000).cast("long"), F.lit(5000).cast("long"))).alias("window_start")).withColumn("window_end", F.col("window_start") + 3000)
    hit = overlap_join(windows, _pages(docs), ["source"], "window_start", "window_end", "s", "e")
    return hit.groupBy("source", "window_start").agg(F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"), F.count("*").alias("n_pages"))


@query("""WITH d AS (SELECT source, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(text) AS n FROM documents),
x AS (SELECT source, CAST(10000 * unnest(range(0, 4)) AS BIGINT) AS x FROM (SELECT DISTINCT source FROM documents))
SELECT x.source, x, min(doc_id) AS page FROM x JOIN d ON d.source = x.source AND s <= x AND x < s + n GROUP BY 1, 2""")
def q_point_in_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9: the first page whose half-open range holds a position."""
    docs = table(spark, sf_dir, "documents")
    points = docs.select("source").distinct().select("source", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 10000, 20000, 30000)])).alias("x")).withColumn("after", F.col("x") + 1)
    hit = overlap_join(points, _pages(docs), ["source"], "x", "after", "s", "e").filter("s < e")
    return hit.groupBy("source", "x").agg(F.min("doc_id").alias("page"))


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def q_anti_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, JN21, SE4: what is expected and has no actual row."""
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    customers = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    return nations.unionByName(customers)


@query("""SELECT text_key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, substr(sha1(text), 1, 16) AS text_key FROM documents) GROUP BY text_key HAVING count(*) > 1""")
def q_content_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, FN4: documents with the same content hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha1("text"), 1, 16).alias("text_key"))
    return rows.groupBy("text_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("""SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) FILTER (c_acctbal > 9000) = 1 THEN min(c_mktsegment) FILTER (c_acctbal > 9000) END AS segment,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey""")
def q_unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, AG5: a value only where all rows agree; sorted distinct values."""
    rich = F.collect_set(F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.when(F.size(rich) == 1, rich[0]).alias("segment"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("""SELECT conv_id, min(turn) AS position, arg_max(role, turn) AS role, arg_max(length(text), turn) AS last_length FROM conversations GROUP BY conv_id""")
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: the last row's value at the first row's position."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("last_length"))
    return L.last_by_key(rows, ["conv_id"], "turn").select("conv_id", "position", "role", "last_length")


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def q_first_wins_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6, AG19: distinct values in order of first appearance, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query("""SELECT lang, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint, count(*) AS n FROM (SELECT lang, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), source, CAST(n_chars AS VARCHAR))) AS h FROM documents) GROUP BY lang""")
def q_table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: an order-free fingerprint of each group of rows."""
    return L.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"], ["lang"])


_LANES = "('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b, ('0x' || substr(h, 31, 15))::BIGINT AS c, ('0x' || substr(h, 46, 7))::BIGINT * ('0x' || substr(h, 53, 7))::BIGINT AS p"


@query(f"""WITH r AS (SELECT l_suppkey, sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS h FROM lineitem), l AS (SELECT l_suppkey, {_LANES} FROM r)
SELECT l_suppkey, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(a) AS VARCHAR), CAST(sum(b) AS VARCHAR), CAST(sum(c) AS VARCHAR), CAST(sum(p) AS VARCHAR))) AS fingerprint, count(*) AS n FROM l GROUP BY l_suppkey""")
def q_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: the content of each group by sums that combine before the shuffle."""
    return L.multiset_fingerprint(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_suppkey"])


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INTEGER) AS pick FROM f WHERE k = 1)
SELECT l_orderkey, l_suppkey, l_linenumber, pick FROM p WHERE pick <= CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 12 END""")
def q_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8: the best line of each supplier, then as many per order as its route allows. Null numbers come last, as in the SQL. Lines of
    equal price and number, whose order the SQL leaves open, go by supplier and part."""
    limit = F.when(F.col("l_orderkey") % 3 == 0, 1).when(F.col("l_orderkey") % 3 == 1, 6).otherwise(12)
    return L.diverse(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_suppkey"], [F.desc("l_extendedprice"), F.asc_nulls_last("l_linenumber"), "l_suppkey", "l_partkey"], limit).select("l_orderkey", "l_suppkey", "l_linenumber", "pick")


@query("""WITH a AS (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 25), b AS (SELECT l_suppkey AS k FROM lineitem WHERE l_discount > 0.05),
x AS (SELECT k, count(*) AS n FROM a GROUP BY k), y AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT coalesce(x.k, y.k) AS k, CASE WHEN coalesce(x.n, 0) > coalesce(y.n, 0) THEN 'left' ELSE 'right' END AS side, abs(coalesce(x.n, 0) - coalesce(y.n, 0)) AS n
FROM x FULL JOIN y USING (k) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def q_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE5: what one table has more often than the other."""
    lines = table(spark, sf_dir, "lineitem")
    left, right = lines.filter("l_quantity > 25").select(F.col("l_suppkey").alias("k")), lines.filter("l_discount > 0.05").select(F.col("l_suppkey").alias("k"))
    return L.multiset_difference(left, right).groupBy("k", "side").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM labels)
SELECT count(*) AS n_left, count(b.p) AS n_right, count(*) FILTER (a.doc_id IS NOT DISTINCT FROM b.doc_id) AS n_same FROM a LEFT JOIN b USING (p)""")
def q_sequence_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE6: two id sequences compared position by position. Positions come from a rank within id ranges and the ranges'
    sizes, so that no single task numbers the whole table."""
    left = L.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    right = L.numbered(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "other")
    both = left.join(right, "position", "left")
    return both.agg(F.count("*").alias("n_left"), F.count("other").alias("n_right"), F.count_if(F.col("doc_id").eqNullSafe(F.col("other"))).alias("n_same"))


@query("""SELECT kind, key, n FROM (SELECT 'orders' AS kind, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL
SELECT 'part', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2) WHERE n > 1""")
def q_dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, SE1: keys that appear on several rows, over several producers."""
    from tessera.operators.graph import repeated

    rows = [(n, table(spark, sf_dir, t).select(F.col(c).cast("string").alias("key"))) for n, t, c in (("orders", "orders", "o_orderkey"), ("part", "part", "p_brand"), ("event", "events", "event_type"))]
    out = None
    for name, df in rows:
        part = repeated(df, ["key"]).select(F.lit(name).alias("kind"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k,
  string_agg(DISTINCT CAST(json_extract(props, '$.k') AS VARCHAR), ',' ORDER BY CAST(json_extract(props, '$.k') AS VARCHAR)) AS ks FROM events GROUP BY user_id, event_type""")
def q_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, FN25: counts by key with values parsed from JSON."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("k").alias("max_k"), F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), ",").alias("ks"))


@query("""WITH j AS (SELECT event_type, ts, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, arg_max(k, struct_pack(ts := ts, e := event_id)) AS latest_k, max(event_id) FILTER (k = 1) AS latest_one FROM j GROUP BY event_type""")
def q_json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN25: the latest payload by (time, id) of each key."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return rows.groupBy("event_type").agg(F.max_by("k", F.struct("ts", "event_id")).alias("latest_k"), F.max(F.when(F.col("k") == 1, F.col("event_id"))).alias("latest_one"))


@query("""SELECT doc_id, lang, n_chars, rank FROM (SELECT doc_id, lang, n_chars, source, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 2""")
def q_strata_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QG17, WN4: the first two rows of each stratum."""
    from tessera.operators.retrieval import top_per

    return top_per(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 2).select("doc_id", "lang", "n_chars", "rank")
