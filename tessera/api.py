"""Batch API: questions in, answers out; a single question is a table of one row.

Units: unit_id, text, document_number, article_number, clause_number, point_number, authority_rank, binding,
source_url, official_source, valid_from, valid_to (dates), temporal_verified, provision_verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import compact_upper, hits
from tessera.operators import evidence as E
from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.operators.alignment import conflicts
from tessera.operators.relational import diverse
from tessera.operators.rounds import Limits, expand_for_gaps, open_slots
from tessera.operators.temporal import temporal_filter
from tessera.sources.scratch import store

CHANNEL_K = 30
#: Phrases whose texts close a slot.
SLOT_PHRASES = {
    "notice_requirement": ("báo trước", "thông báo trước"),
    "exceptions": ("trừ trường hợp", "không áp dụng", "không phải", "ngoại lệ", "14 ngày", "16 ngày"),
    "termination_conditions": ("chấm dứt", "đơn phương", "sa thải", "thôi việc"),
}


def answer(questions: DataFrame, units: DataFrame, as_of: str, strict: bool = False, max_units: int = 12, dense: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """query_id, state, route, issues, missing_facts, citations (unit ids by rank), answer (their texts, compressed).

    dense: optional ranked channel (query_id, unit_id, rank), e.g. from `retrieval.dense_top_k` over stored vectors.
    edges: optional graph (edge_id, source, target, type) over unit ids and other nodes: questions whose evidence leaves
    slots open then take rounds over it (one, three if complex, none if direct), and open slots and their coverage decide
    between a sufficient and a partial answer.
    Questions that lack facts stop before retrieval; a question without any usable unit is INSUFFICIENT_EVIDENCE, one whose
    chosen units hold different texts of the same place is CONFLICTING_EVIDENCE.
    """
    asked = Q.analyze(Q.intake(questions), as_of).withColumn("slots", Q.mandatory_slots())
    ready = asked.filter(F.size("missing_facts") == 0)
    refs = ready.select("query_id", F.explode("refs").alias("r")).filter("r.instrument is not null")
    refs = refs.select("query_id", compact_upper(F.col("r.instrument")).alias("number"), *[F.upper(f"r.{c}").alias(c) for c in ("article", "clause", "point")])
    keyed = units.select("unit_id", "authority_rank", compact_upper(F.col("document_number")).alias("number"), *[F.when(F.col(f"{c}_number") != "", F.upper(f"{c}_number")).alias(c) for c in ("article", "clause", "point")])
    exact = R.exact_lookup(keyed, refs, "query_id", ["number", "article", "clause", "point"], "unit_id", "authority_rank").select("query_id", "unit_id", "rank")
    lexical = R.bm25(units, "unit_id", "text", ready, "query_id", "normalized", CHANNEL_K)
    channels = [("exact", exact), ("bm25", lexical)] + ([("dense", dense)] if dense is not None else [])
    fused = R.reciprocal_rank_fusion(channels, ["query_id"], "unit_id", CHANNEL_K)
    items = fused.join(units, "unit_id").join(ready.select("query_id", "normalized", "route", F.to_date("query_date").alias("day")), "query_id")
    kept = temporal_filter(items, "day", strict).filter("kept")
    authority = R.authority_score(F.col("authority_rank"), F.col("binding"), F.col("source_url").isNotNull(), F.col("official_source"))
    ranked = R.rerank(kept, ["query_id"], "unit_id", "rrf", authority, F.col("temporal_verified"))
    shared = E.applicable(F.col("text"), F.col("normalized"), F.col("methods").contains("exact"), F.lit(True))
    usable = ranked.filter(shared)
    found = None
    if edges is not None:
        usable, found = _in_rounds(ready, usable, units, edges, strict)
    limit = F.when(F.col("route") == "DIRECT", 1).when(F.col("route") == "STANDARD", min(6, max_units)).otherwise(max_units)
    chosen = diverse(usable, ["query_id"], ["unit_id"], [F.col("final_rank")], limit)
    chosen = chosen.withColumn("line", F.concat(E.compress(F.col("text"), F.col("normalized")), F.lit(" ["), F.col("unit_id"), F.lit("]")))
    reviewed = F.coalesce("provision_verified", F.lit(False)) & F.col("source_url").isNotNull()
    # versions of one place that say different things, both still in force for the question
    places = chosen.withColumn("place", F.concat_ws("|", "query_id", compact_upper(F.col("document_number")), *[F.coalesce(F.upper(f"{c}_number"), F.lit("")) for c in ("article", "clause", "point")]))
    clash = conflicts(places, "place", "pick", "text", "unit_id").select(F.col("identity").alias("place")).distinct()
    clash = places.select("query_id", "place").distinct().join(clash, "place").select("query_id", F.lit(True).alias("conflicting")).distinct()
    packs = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pick", "unit_id", "line"))).alias("p"), F.count("*").alias("n"), F.count_if(reviewed).alias("n_reviewed"))
    out = asked.join(packs, "query_id", "left").join(clash, "query_id", "left")
    n, n_reviewed = F.coalesce("n", F.lit(0)), F.coalesce("n_reviewed", F.lit(0))
    undated = F.col("query_date").isNull() | (n_reviewed > 0)
    gaps = F.when(undated & (n > 0), 0).otherwise(1)
    covered = F.when(n_reviewed > 0, 1.0).when(n > 0, 0.5).otherwise(0.0)
    if found is not None:
        out = out.join(found, "query_id", "left")
        gaps, covered = F.coalesce(F.size("gaps"), F.lit(1)), F.coalesce("coverage", F.lit(0.0))
    state = E.answer_state(F.coalesce("conflicting", F.lit(False)), F.size("missing_facts"), n, covered, gaps)
    none = F.array().cast("array<string>")
    return out.select(
        "query_id",
        "question",
        state.alias("state"),
        "route",
        "issues",
        "missing_facts",
        F.coalesce(F.transform("p", lambda x: x["unit_id"]), none).alias("citations"),
        F.coalesce(F.array_join(F.transform("p", lambda x: x["line"]), "\n"), F.lit("")).alias("answer"),
    )


def _slots_of(units: DataFrame) -> DataFrame:
    """units as `expand_for_gaps` takes them, with the slots each of them closes."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = F.lower("text")
    says = lambda phrases: F.coalesce(hits(low, list(phrases)) > 0, F.lit(False))
    closes = {
        "governing_rule": yes("provision_verified"),
        "conditions": yes("provision_verified"),
        "official_source": yes("official_source") & F.col("source_url").isNotNull(),
        "applicable_version": yes("provision_verified") | yes("temporal_verified"),
        "implementing_regulation": F.coalesce(F.col("document_number").rlike("NĐ-CP|TT-"), F.lit(False)),
        **{slot: says(phrases) for slot, phrases in SLOT_PHRASES.items()},
    }
    fills = F.array_compact(F.array(*[F.when(test, F.lit(slot)) for slot, test in closes.items()]))
    authority = R.authority_score(F.col("authority_rank"), F.col("binding"), F.col("source_url").isNotNull(), F.col("official_source"))
    return units.select("unit_id", "text", authority.alias("authority"), F.col("temporal_verified").alias("temporal"), F.lit(True).alias("usable"), fills.alias("fills"))


def _in_rounds(ready: DataFrame, usable: DataFrame, units: DataFrame, edges: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(usable and what rounds over the graph add to it, ranked anew; query_id, gaps, coverage)."""
    usable = store(usable, "usable")  # read by the rounds and by the answer
    rounds = F.when(F.col("route") == "DIRECT", 0).when(F.col("route") == "STANDARD", 1).otherwise(Limits().rounds)
    asked = ready.select("query_id", F.col("normalized").alias("text"), "slots", rounds.alias("rounds"))
    evidence, _ = expand_for_gaps(asked, usable.select("query_id", "unit_id"), edges, _slots_of(units))
    new = evidence.filter("round > 0").select("query_id", "unit_id", F.col("score").alias("rrf"), F.lit("graph").alias("methods"))
    items = new.join(units, "unit_id").join(ready.select("query_id", "normalized", "route", F.to_date("query_date").alias("day")), "query_id")
    kept = temporal_filter(items, "day", strict).filter("kept").filter(E.applicable(F.col("text"), F.col("normalized"), F.lit(False), F.lit(True)))
    both = usable.drop("final", "final_rank").unionByName(kept, allowMissingColumns=True)
    authority = R.authority_score(F.col("authority_rank"), F.col("binding"), F.col("source_url").isNotNull(), F.col("official_source"))
    both = store(R.rerank(both, ["query_id"], "unit_id", "rrf", authority, F.col("temporal_verified")), "usable")
    # only what passed the filters of time and applicability closes slots
    held = evidence.join(both.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_semi")
    return both, open_slots(ready.select("query_id", "slots"), held)


def build(spark, manifest: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """Stage tables of a corpus: texts (document_id, text) through cleaning, segments, provisions and quarantine."""
    from tessera.functions.text import clean_lines
    from tessera.operators import structure as S

    clean = store(texts.select("document_id", clean_lines(F.coalesce("text", F.lit(""))).alias("text")), "texts")
    rows = store(S.quarantine(S.provisions(clean)), "provisions")
    return {"manifest": manifest, "documents": clean, "segments": S.segments(clean), "provisions": rows.filter("not quarantined"), "quarantined": rows.filter("quarantined")}
