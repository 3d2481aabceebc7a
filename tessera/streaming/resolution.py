"""Source resolution as a fold over a stream of fetch outcomes, whose candidates persist and whose runs resume.

An outcome is one attempt at one candidate: record_id, candidate_id, role (BINARY, IDENTITY, STATUS_HISTORY, ...),
required, provider, url, state, reasons (array<string>), identity_match, trusted, seq.

What a candidate comes to is the greatest of its outcomes, by an order that needs no arrival order: evidence stays as it
was first found (a candidate with evidence isn't fetched again), without it the last attempt counts, without one the
last entry in the queue. A greatest row is commutative, associative and idempotent, so that tables, batches, replays and
restarts give the same candidates; it combines before the shuffle, so that a record with a third of all outcomes costs
no task more than its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.files import exists

#: States of candidates and records.
PENDING = ("FETCH_PENDING", "DISCOVERED")
BLOCKED, REVIEW, EXACT = "BLOCKED", "NEEDS_REVIEW", "AUTO_EXACT_SHA"
IDENTITY_ROLES = ("IDENTITY", "STATUS_HISTORY")
#: Reasons that the decision itself adds.
NOT_FETCHED, NO_IDENTITY = "BINARY_NOT_FETCHED", "IDENTITY_FAILED"

KEYS = ("record_id", "candidate_id")
FIELDS = ("role", "required", "provider", "url", "state", "reasons", "identity_match", "trusted")


def _standing() -> Column:
    """(kind of outcome, recency): evidence over failed attempts over queueing; the first evidence, else the last row."""
    kind = F.when(F.col("state").isin(*PENDING), 0).when(F.col("state") == BLOCKED, 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.when(kind == 2, -F.col("seq")).otherwise(F.col("seq")).alias("recency"))


def fold(outcomes: DataFrame) -> DataFrame:
    """One row per candidate, with seq of the outcome that stands; over tables, streams (update mode) and its own output.

    Rows without a record or candidate are no outcomes. Null states count as pending, null flags as false, null reasons as
    none, a null seq as the least. Rows that tie in seq are told apart by their contents, so ties don't depend on order.
    """
    least = F.lit(-(2**62)).cast("long")
    clean = outcomes.filter(F.col("record_id").isNotNull() & F.col("candidate_id").isNotNull()).withColumns(
        {
            "seq": F.coalesce(F.col("seq").cast("long"), least),
            "state": F.coalesce("state", F.lit(PENDING[0])),
            "required": F.coalesce("required", F.lit(False)),
            "identity_match": F.coalesce("identity_match", F.lit(False)),
            "trusted": F.coalesce("trusted", F.lit(False)),
            "reasons": F.array_sort(F.array_distinct(F.array_compact(F.coalesce("reasons", F.array().cast("array<string>"))))),
        }
    )
    best = F.max(F.struct(_standing().alias("standing"), "seq", *FIELDS)).alias("c")
    return clean.groupBy(*KEYS).agg(best).select(*KEYS, "c.seq", *[f"c.{f}" for f in FIELDS])


def record_decisions(candidates: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """record_id, state, reasons, blocking, warnings (sorted arrays), candidate_id and url of the binary chosen, identity_ok.

    The best binary is a trusted one over any other, an exact one over others, one whose contents name the record over one
    that doesn't; then the shorter provider name, then the later provider, url and id. Blocking reasons are those of
    blocked candidates, unless a trusted binary and the identity stand anyway, or the candidate only served identity beside
    a binary. `records` (record_id) adds those without any candidate.
    """
    state = F.col("state")
    binary, evidence = F.col("role") == "BINARY", ~state.isin(*PENDING, BLOCKED)
    fetched = binary & evidence
    rank = F.when(~F.col("trusted"), 0).otherwise(2 * (state == EXACT).cast("int") + F.col("identity_match").cast("int") + 2)
    chosen = F.struct(rank.alias("rank"), (-F.length("provider")).alias("short"), "provider", "url", "candidate_id", "state", "reasons")
    tried = ~state.isin(*PENDING)
    found = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    # reasons come from a fixed vocabulary, and sets combine before the shuffle
    sets = lambda test: F.collect_set(F.when(test & (F.size("reasons") > 0), F.col("reasons")))
    rows = candidates.groupBy("record_id").agg(
        F.max(F.when(fetched, chosen)).alias("b"),
        found((F.col("role").isin(*IDENTITY_ROLES) | binary) & evidence & F.col("identity_match")).alias("identity_ok"),
        found(binary).alias("has_binary"),
        found(binary & tried).alias("tried"),
        found(binary & tried & (state != BLOCKED)).alias("not_blocked"),
        found(F.col("required") & state.isin(*PENDING)).alias("pending"),
        found(state == REVIEW).alias("review"),
        found(state != BLOCKED).alias("other"),
        sets(tried).alias("said"),
        sets((state == BLOCKED) & ~F.col("role").isin(*IDENTITY_ROLES)).alias("barred"),
        sets((state == BLOCKED) & F.col("role").isin(*IDENTITY_ROLES)).alias("barred_identity"),
    )
    if records is not None:
        rows = records.select("record_id").filter("record_id is not null").distinct().join(rows, "record_id", "left")
    known = F.col("other").isNotNull()
    none, reasons_of = F.array().cast("array<string>"), lambda *c: F.flatten(F.concat(*[F.coalesce(x, F.array().cast("array<array<string>>")) for x in c]))
    trusted = F.coalesce(F.col("b.rank") > 0, F.lit(False))
    blocked = F.col("tried") & ~F.col("not_blocked") & ~trusted
    verdict = lambda name, added: F.struct(F.lit(name).alias("state"), added.alias("added"))
    only = lambda reason: F.array(F.lit(reason))
    without = F.col("b").isNull()
    decided = (
        F.when(~known, verdict(REVIEW, only(NOT_FETCHED)))
        .when(blocked, verdict(BLOCKED, none))
        .when(without & F.col("pending"), verdict("FETCH_PENDING", only(NOT_FETCHED)))
        .when(without & ~F.col("review") & ~F.col("other"), verdict(BLOCKED, none))
        .when(without, verdict(REVIEW, only(NOT_FETCHED)))
        .when(F.col("b.state") != EXACT, verdict(REVIEW, F.col("b.reasons")))
        .when(~F.col("identity_ok"), verdict(REVIEW, only(NO_IDENTITY)))
        .otherwise(verdict(EXACT, none))
    )
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    bars = F.when(trusted & F.col("identity_ok"), none).when(F.coalesce("has_binary", F.lit(False)), reasons_of(F.col("barred"))).otherwise(reasons_of(F.col("barred"), F.col("barred_identity")))
    out = rows.withColumn("d", decided).withColumns({"blocking": tidy(bars), "reasons": tidy(F.concat(reasons_of(F.col("said")), "d.added"))})
    return out.select(
        "record_id",
        "d.state",
        "reasons",
        "blocking",
        F.array_except("reasons", "blocking").alias("warnings"),
        F.col("b.candidate_id").alias("candidate_id"),
        F.col("b.url").alias("url"),
        F.coalesce("identity_ok", F.lit(False)).alias("identity_ok"),
    )


def resolve_stream(outcomes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of outcomes; each batch writes the candidates it changed below `target`, in a folder of its number.

    A batch that runs again after a failure replaces its own folder. A restart from the checkpoint goes on where the last
    one ended: the folded candidates are state of the query, so outcomes are read once.
    """

    def batch(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fold(outcomes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def persisted(spark: SparkSession, target: str) -> DataFrame:
    """The candidates as all batches so far left them; none before the first batch."""
    if not exists(spark, target):
        schema = "record_id string, candidate_id string, seq long, role string, required boolean, provider string, url string, state string, reasons array<string>, identity_match boolean, trusted boolean"
        return spark.createDataFrame([], schema)
    return fold(spark.read.parquet(target).drop("batch"))
