"""Changes applied to versions: orders as reviewed changes, each customer as an identity with one version to begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes as H
from tessera.plans.registry import query
from tessera.session import table

_SQL = """ch AS (SELECT o_orderkey AS change_id, o_custkey AS identity, CASE o_orderstatus WHEN 'F' THEN 'AMEND' WHEN 'O' THEN 'REPLACE' WHEN 'P' THEN 'REPEAL' END AS operation,
  CAST(o_orderdate AS DATE) AS d, o_orderpriority <> '5-LOW' AS ok FROM orders),
v AS (SELECT c_custkey AS identity, DATE '1993-01-01' AS f, CASE WHEN c_acctbal < 0 THEN DATE '1997-01-01' END AS t FROM customer),
s AS (SELECT change_id, count(*) OVER (PARTITION BY identity, d) AS k FROM ch WHERE ok AND operation IS NOT NULL),
r AS (SELECT ch.*, v.f, v.t, CASE WHEN NOT ok THEN 'NOT_APPROVED' WHEN operation IS NULL THEN 'UNKNOWN_OPERATION' WHEN k > 1 THEN 'CONFLICT' WHEN v.f IS NULL THEN 'NOT_IN_FORCE' WHEN v.f = d THEN 'AT_START' END AS reason
  FROM ch LEFT JOIN s USING (change_id) LEFT JOIN v ON v.identity = ch.identity AND v.f <= ch.d AND (v.t IS NULL OR ch.d < v.t)),
e AS (SELECT identity, min(d) AS repealed FROM r WHERE reason IS NULL AND operation = 'REPEAL' GROUP BY identity),
p AS (SELECT r.change_id, r.identity, r.operation, r.d, coalesce(reason, CASE WHEN d > repealed THEN 'AFTER_REPEAL' END) AS reason FROM r LEFT JOIN e USING (identity))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("c_acctbal") < 0, F.lit("1997-01-01").cast("date"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("version_id"), F.lit("1993-01-01").cast("date").alias("valid_from"), end.alias("valid_to"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.lit(o)) for s, o in zip("FOP", H.OPERATIONS)])
    status = F.when(F.col("o_orderpriority") != "5-LOW", "APPROVED").otherwise("DRAFT")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("identity"), operation.alias("operation"), F.to_date("o_orderdate").alias("effective_from"), status.alias("review_status"))


@query(f"""WITH {_SQL}, b AS (SELECT identity, f AS valid_from, NULL AS introduced_by, '' AS operation, t FROM v UNION ALL SELECT p.identity, d, change_id, operation, t FROM p JOIN v USING (identity) WHERE reason IS NULL),
w AS (SELECT *, lead(introduced_by) OVER o AS ended_by, coalesce(lead(valid_from) OVER o, t) AS valid_to FROM b WINDOW o AS (PARTITION BY identity ORDER BY valid_from))
SELECT identity, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, 'v' || identity AS base_version, introduced_by, ended_by FROM w WHERE operation <> 'REPEAL'""")
def q_applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST7, JN11: every version after the changes that apply."""
    out = H.applied_changes(_versions(spark, sf_dir), _changes(spark, sf_dir))
    return out.select("identity", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), "base_version", "introduced_by", "ended_by")


@query(f"WITH {_SQL} SELECT operation, coalesce(reason, 'APPLIED') AS outcome, count(*) AS n FROM p GROUP BY ALL")
def q_change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, RV4: what applies, and why the rest doesn't."""
    out = H.placed_changes(_versions(spark, sf_dir), _changes(spark, sf_dir))
    return out.groupBy("operation", F.coalesce("reason", F.lit("APPLIED")).alias("outcome")).agg(F.count("*").alias("n"))
