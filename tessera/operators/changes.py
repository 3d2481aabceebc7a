"""Reviewed changes applied to versions: intervals are cut, ended and begun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import stable_id
from tessera.operators.intervals import overlap_join
from tessera.sources.scratch import store

#: What a change does.
OPERATIONS = ("AMEND", "REPLACE", "REPEAL")
_FAR = 2_932_897  # days: after 9999-12-31


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def checked_versions(versions: DataFrame) -> DataFrame:
    """versions with `problem`, null where a version can be worked with: MISSING_START, EMPTY_INTERVAL, OVERLAP with the
    version of the same identity that begins next."""
    w = Window.partitionBy("identity").orderBy("valid_from", "version_id")
    next_from = F.lead("valid_from").over(w)
    problem = F.when(F.col("valid_from").isNull(), "MISSING_START").when(F.col("valid_to") <= F.col("valid_from"), "EMPTY_INTERVAL")
    return versions.withColumn("problem", problem.when(next_from.isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > next_from)), "OVERLAP"))


def placed_changes(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """change_id, identity, operation, effective_from, version_id (of the version it cuts), reason (null: it applies).

    versions: identity, version_id, valid_from, valid_to (half-open dates, no overlaps: see checked_versions); changes:
    change_id (unique), identity, operation, effective_from, review_status. In this order of precedence:
    NOT_APPROVED; UNKNOWN_OPERATION; MISSING_DATE; CONFLICT (several approved ones of an identity on one day, of which none
    applies); NOT_IN_FORCE (no version holds then); AT_START (the version begins that day, so there is nothing to end);
    AFTER_REPEAL (an earlier change ended the version without a successor).
    """
    known = changes.select("change_id", "identity", "operation", "effective_from", "review_status")
    first = F.when(~F.coalesce(F.col("review_status") == "APPROVED", F.lit(False)), "NOT_APPROVED")
    first = first.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "UNKNOWN_OPERATION")
    first = first.when(F.col("effective_from").isNull() | F.col("identity").isNull(), "MISSING_DATE")
    known = store(known.withColumn("first", first), "changes")
    sound = known.filter("first is null")
    same_day = sound.groupBy("identity", "effective_from").agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("clash", F.lit(True))
    points = sound.withColumn("day", _day("effective_from")).withColumn("after", F.col("day") + 1)
    spans = versions.select("identity", "version_id", F.col("valid_from").alias("begins"), _day("valid_from").alias("from_day"), F.coalesce(_day("valid_to"), F.lit(_FAR)).alias("to_day"))
    held = overlap_join(points.select("change_id", "identity", "day", "after"), spans, ["identity"], "day", "after", "from_day", "to_day").select("change_id", "version_id", "begins")
    found = known.join(held, "change_id", "left").join(same_day, ["identity", "effective_from"], "left")
    reason = F.coalesce("first", F.when(F.col("clash"), "CONFLICT").when(F.col("version_id").isNull(), "NOT_IN_FORCE").when(F.col("begins") == F.col("effective_from"), "AT_START"))
    found = store(found.withColumn("reason", reason), "placed")
    ends = found.filter("reason is null and operation = 'REPEAL'").groupBy("version_id").agg(F.min("effective_from").alias("repealed"))
    out = found.join(ends, "version_id", "left")
    late = F.when(F.col("effective_from") > F.col("repealed"), "AFTER_REPEAL")
    return out.select("change_id", "identity", "operation", "effective_from", "version_id", F.coalesce("reason", late).alias("reason"))


def applied_changes(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """version_id, identity, valid_from, valid_to, base_version, introduced_by, ended_by: the versions after all changes
    that apply.

    An amendment or replacement ends what holds that day and begins a new version, whose id follows from the identity and
    the change; a repeal ends it. The last piece ends when its base version did. Raises where versions are unsound.
    """
    bad = checked_versions(versions).filter("problem is not null").limit(5).collect()
    if bad:
        raise ValueError(f"unsound versions: {[(r['version_id'], r['problem']) for r in bad]}")
    cuts = placed_changes(versions, changes).filter("reason is null")
    bases = versions.select("identity", F.col("version_id").alias("base_version"), "valid_from", F.col("valid_to").alias("base_to"))
    begun = bases.select("*", F.lit(None).cast(dict(changes.dtypes)["change_id"]).alias("introduced_by"), F.lit("").alias("operation"))
    cut = cuts.select(F.col("version_id").alias("base_version"), "effective_from", "change_id", "operation").join(bases.drop("valid_from"), "base_version")
    cut = cut.select("identity", "base_version", F.col("effective_from").alias("valid_from"), "base_to", F.col("change_id").alias("introduced_by"), "operation")
    w = Window.partitionBy("base_version").orderBy("valid_from")
    rows = begun.unionByName(cut).withColumn("ended_by", F.lead("introduced_by").over(w)).withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), "base_to"))
    own = F.when(F.col("introduced_by").isNull(), F.col("base_version").cast("string")).otherwise(stable_id("provision_version", F.col("identity").cast("string"), F.col("introduced_by").cast("string")))
    return rows.filter("operation <> 'REPEAL'").select(own.alias("version_id"), "identity", "valid_from", "valid_to", "base_version", "introduced_by", "ended_by")
