"""Analysis of a table of questions: issues, references, dates, facts, route and the evidence it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import legal as G

#: Facts that an assessment needs, by issue, with the prompts that ask for them.
NEEDED = {
    "TERMINATION": {"termination_date": "Ngày chấm dứt là ngày nào?", "contract_type": "Loại hợp đồng là gì?", "termination_reason": "Lý do chấm dứt là gì?", "notice_days": "Công ty đã báo trước bao nhiêu ngày?"},
    "WAGE": {"work_date": "Thời điểm phát sinh tiền lương là khi nào?"},
}


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def intake(questions: DataFrame, text: str = "question") -> DataFrame:
    """questions with query_id and normalized: white space collapsed, id from a hash. Texts are taken to be composed."""
    normal = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    return questions.withColumn("normalized", normal).withColumn("query_id", F.concat(F.lit("query_"), F.substring(F.sha2(normal, 256), 1, 16)))


def analyze(questions: DataFrame, as_of: str, text: str = "normalized") -> DataFrame:
    """questions with issues, refs, query_date, precision, outcome, temporal_intent, route, missing_facts.

    `as_of` stands for today, so that results can be repeated.
    """
    q = F.col(text)
    low = F.lower(q)
    out = questions.withColumns({"issues": G.issues_of(q), "refs": G.references(q), "dates": G.event_dates(q), "month": G.event_month(q)})
    has_day = F.size("dates") > 0
    out = out.withColumn("query_date", F.when(has_day, F.col("dates")[0]).when(F.col("month").isNotNull(), F.concat(F.col("month"), F.lit("-01"))))
    out = out.withColumn("precision", F.when(has_day, "DAY").when(F.col("month").isNotNull(), "MONTH").otherwise("NONE"))
    outcome = (
        F.when((F.size("refs") > 0) & _any(low, ["quy định gì", "nội dung", "tra cứu"]), "LOOKUP")
        .when(_any(low, ["bản án", "án lệ"]), "FIND_CASE")
        .when(low.contains("so sánh"), "COMPARE")
        .when(_any(low, ["đúng luật", "trái luật", "có được"]), "ASSESS_LEGALITY")
        .otherwise("EXPLAIN")
    )
    out = out.withColumn("outcome", outcome)
    past = F.col("query_date") < as_of
    intent = F.when(past, "HISTORICAL").when(F.col("query_date").isNotNull(), "EXPLICIT_DATE").when(_any(low, ["hiện nay", "bây giờ", "mới nhất"]), "CURRENT").otherwise("NONE")
    out = out.withColumn("temporal_intent", intent)
    hard = (F.size("issues") > 1) | F.coalesce(past & (F.col("outcome") == "ASSESS_LEGALITY"), F.lit(False)) | _any(low, ["sửa đổi", "bãi bỏ", "thay thế", "so sánh", "qua các thời kỳ"])
    exact = F.exists("refs", lambda r: r["instrument"].isNotNull() & r["article"].isNotNull())
    out = out.withColumn("route", F.when(exact & (F.col("outcome") == "LOOKUP"), "DIRECT").when(hard, "COMPLEX").otherwise("STANDARD"))
    stated = G.facts(low)
    present = {
        "termination_date": F.col("query_date").isNotNull(),
        "work_date": F.col("query_date").isNotNull(),
        "contract_type": stated["contract_type"].isNotNull(),
        "termination_reason": _any(low, ["vì", "do ", "lý do"]),
        "notice_days": stated["notice_days"].isNotNull(),
    }
    asks = [F.when(F.array_contains("issues", issue) & ~present[field], prompt) for issue, fields in NEEDED.items() for field, prompt in fields.items()]
    missing = F.array_sort(F.array_distinct(F.array_compact(F.array(*asks))))
    return out.withColumn("missing_facts", F.when(F.col("outcome") == "ASSESS_LEGALITY", missing).otherwise(F.array().cast("array<string>")))


def mandatory_slots() -> Column:
    """Evidence that an analysed question needs, in order."""
    has = lambda issue: F.array_contains("issues", issue)
    empty = F.array().cast("array<string>")
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    dated = F.when(F.col("query_date").isNotNull() | (F.col("temporal_intent") == "CURRENT"), names("applicable_version")).otherwise(empty)
    by_issue = (
        F.when(has("TERMINATION"), names("termination_conditions", "notice_requirement", "exceptions"))
        .when(has("LEAVE") | (F.col("outcome") == "ASSESS_LEGALITY"), names("conditions", "exceptions"))
        .otherwise(empty)
    )
    linked = F.when(F.col("route") == "COMPLEX", names("mandatory_reference")).otherwise(empty)
    return F.array_distinct(F.concat(names("governing_rule", "official_source"), dated, by_issue, linked))
