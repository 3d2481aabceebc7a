"""Half-open validity: start inclusive, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strict_date

#: Fixed values.
KNOWN_STATUS = ("EFFECTIVE", "EXPIRED", "PARTIALLY_EXPIRED")


def within(start: Column, end: Column, when: Column) -> Column:
    return (start <= when) & (end.isNull() | (when < end))


def eligible(when: Column, c: dict[str, Column]) -> Column:
    """Whether a record holds at a date; anything unknown excludes it.

    c: temporal_verified, valid_from, valid_to, legal_status, and optionally is_provision, provision_verified,
    version_role, consolidation_as_of, status_checked_at, coverage_as_of.
    """
    none, no = F.lit(None).cast("string"), F.lit(False)
    get = lambda name, default=none: c.get(name, default)
    start, end = strict_date(get("valid_from")), strict_date(get("valid_to"))
    ok = F.coalesce(get("temporal_verified"), no) & (~F.coalesce(get("is_provision", no), no) | F.coalesce(get("provision_verified", no), no))
    ok = ok & when.isNotNull() & start.isNotNull() & (get("valid_to").isNull() | end.isNotNull())
    consolidated = F.coalesce(get("version_role") == "CONSOLIDATED", no)
    ok = ok & (~consolidated | F.coalesce(when >= strict_date(get("consolidation_as_of")), no))
    ok = ok & (get("status_checked_at").isNull() | end.isNotNull() | F.coalesce(when <= strict_date(get("status_checked_at")), no))
    ok = ok & (get("coverage_as_of").isNull() | F.coalesce(when <= strict_date(get("coverage_as_of")), no))
    status = get("legal_status")
    ok = ok & F.coalesce(status.isin(*KNOWN_STATUS), no) & ~((status == "EXPIRED") & end.isNull())
    return F.coalesce(ok & within(start, end, when), no)


def temporal_filter(items: DataFrame, when: str, strict: bool) -> DataFrame:
    """items with kept and warning. Without a date all stay. A provision whose own interval isn't reviewed goes, unless
    the filter isn't strict and the document's is; a missing start goes."""
    day = F.col(when)
    reviewed = F.coalesce(F.col("provision_verified"), F.lit(False))
    fallback = ~reviewed & F.coalesce(F.col("temporal_verified"), F.lit(False)) & F.lit(not strict)
    holds = F.coalesce(within(F.col("valid_from"), F.col("valid_to"), day), F.lit(False))
    kept = day.isNull() | ((reviewed | fallback) & holds)
    return items.withColumn("kept", kept).withColumn("warning", F.when(day.isNotNull() & kept & fallback, F.lit("DOCUMENT_LEVEL_TEMPORAL_FALLBACK")))


def versions_at(versions: DataFrame, key: list[str], when: Column) -> DataFrame:
    """The version of each key that holds at a date, and n_versions: more than one is a conflict."""
    rows = versions.filter(within(F.col("valid_from"), F.col("valid_to"), when))
    return rows.groupBy(*key).agg(F.count_distinct("version_id").alias("n_versions"), F.min("version_id").alias("version_id"))


def overlaps(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Consecutive versions of a key whose left end is missing or after the right start."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = versions.withColumn("next_from", F.lead("valid_from").over(w)).withColumn("next_version", F.lead("version_id").over(w))
    return rows.filter(F.col("next_version").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("next_from"))))


def intervals_from_events(rows: DataFrame, key: list[str], order: list[str], start: str) -> DataFrame:
    """Half-open intervals: each row is valid until the key's next one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w))
