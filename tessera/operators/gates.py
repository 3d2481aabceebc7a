"""Quality gates: every check is a select of (severity, type, id, detail) rows, and a gate is the absence of some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import missing, strict_date


def issue(rows: DataFrame, condition: Column, severity: str, kind: str, key: Column, detail: Column | None = None) -> DataFrame:
    text = detail.cast("string") if detail is not None else F.lit(None).cast("string")
    return rows.filter(condition).select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), key.cast("string").alias("id"), text.alias("detail"))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate(issues: DataFrame, fatal: list[str]) -> DataFrame:
    """One row: passed, and counts by severity."""
    return issues.agg((F.count_if(F.col("severity").isin(*fatal)) == 0).alias("passed"), *[F.count_if(F.col("severity") == s).alias("n_" + s.lower()) for s in ("ERROR", "WARN", "INFO")])


def catalog_missing(c: dict[str, Column], authoritative: Column) -> Column:
    """Names of what a catalog record lacks, in a fixed order."""
    plain = ("sha256", "source_provider", "source_url", "collected_at", "reviewer", "reviewed_at", "review_evidence")
    empty = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    problems = {f: empty(c[f]) for f in plain}
    problems["official_source"] = authoritative & ~F.coalesce(c["official_source"], F.lit(False))
    for f in ("collected_at", "reviewed_at"):
        problems["valid_" + f] = ~empty(c[f]) & strict_date(c[f]).isNull()
    problems["review_before_collection"] = F.coalesce(strict_date(c["reviewed_at"]) < strict_date(c["collected_at"]), F.lit(False))
    problems["https_source_url"] = ~empty(c["source_url"]) & ~c["source_url"].startswith("https://")
    return missing(problems)


def first_and_repeats(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with repeat: whether the key stood on an earlier row."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def gold_problems(c: dict[str, Column]) -> Column:
    """What keeps a gold question from being used."""
    approved = c["review_status"] == "APPROVED"
    lacks = lambda x: F.coalesce(x, F.lit("")) == ""
    none = F.coalesce(F.size(c["gold_unit_ids"]), F.lit(0)) <= 0
    abstain = c["query_type"] == "INSUFFICIENT_FACTS"
    return missing(
        {
            "MISSING_QUESTION": lacks(c["question"]),
            "UNKNOWN_STATUS": ~F.coalesce(c["review_status"].isin("DRAFT", "APPROVED", "REJECTED"), F.lit(False)),
            "APPROVED_WITHOUT_REVIEWER": approved & (lacks(c["reviewer"]) | lacks(c["reviewed_at"]) | lacks(c["build_id"])),
            "MISSING_QRELS": approved & ~abstain & none,
            "MUST_EXPECT_NO_ANSWER": abstain & ~F.coalesce(c["expected_no_answer"], F.lit(False)),
            "MISSING_DATE": c["query_type"].isin("TEMPORAL", "AMENDMENT") & lacks(c["query_date"]),
        }
    )


def group_cases(rows: DataFrame, key: list[str], member: str, interval: list[str]) -> DataFrame:
    """key, n, intervals (distinct, sorted), members_sha: one review case per group."""
    spans = F.array_sort(F.collect_set(F.concat_ws("..", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in interval])))
    ids = F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ","), 256)
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(spans, ";").alias("intervals"), ids.alias("members_sha"))


def stratified(rows: DataFrame, pools: dict[str, Column], key: str, k: int) -> DataFrame:
    """pool, key, pick: the first k rows of each pool by key; pools may overlap."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in pools.items()]))
    exploded = rows.select(F.col(key), F.explode(names).alias("pool"))
    return exploded.withColumn("pick", F.row_number().over(Window.partitionBy("pool").orderBy(key))).filter(F.col("pick") <= k)


def overall(failed_code: Column, waiting_review: Column, waiting_remote: Column) -> Column:
    return F.when(failed_code, "FAILED_CODE").when(waiting_review, "WAITING_FOR_HUMAN_REVIEW").when(waiting_remote, "WAITING_FOR_REMOTE_EXECUTION").otherwise("COMPLETE")
