"""Audits over the tables of a build: violations as rows (gate or type, id), verdicts from their counts.

Every check is a filter or a join of its own tables; nothing is gathered in one value, so a gate with very many
violations costs as much as one with few. Tables may be empty; null fields count as not stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strict_date
from tessera.operators.corpus import reason_known
from tessera.operators.gates import issue, together
from tessera.operators.graph import repeated

#: Gates of the resolver's audit, in order.
RESOLVER_GATES = (
    "candidate_column_metadata_mismatches", "identity_or_status_mismatch_saved_as_fetched", "home_shell_saved_as_fetched", "html_final_binary_urls", "auto_exact_without_authority", "auto_exact_without_identity",
    "best_binary_field_mismatches", "conflicting_sha_semantics", "blocking_reasons_from_satisfied_alternatives", "browser_derived_orphans", "duplicate_candidates", "duplicate_evidence_events",
    "invalid_override_entries", "provider_role_route_violations", "unclassified_reason_codes", "resolver_code_errors", "nonterminal_records", "required_candidates_pending",
)
#: States and reasons that the gates speak of.
TERMINAL = ("AUTO_EXACT_SHA", "AUTO_CONTENT_MATCH", "NEEDS_REVIEW", "BLOCKED")
WRONG_PAGE = ("IDENTITY_NOT_FOUND", "IDENTITY_MISMATCH", "VBPL_HOME_SHELL", "DOCUMENT_NOT_FOUND")
#: Fields a legal document must state, and its dates.
REQUIRED_FIELDS = ("instrument_number", "title", "issuer", "promulgated_date", "source_url")
DATE_FIELDS = ("promulgated_date", "effective_from", "effective_to", "valid_from", "valid_to", "consolidation_as_of")
#: Document kinds that have articles, and the level above each.
WITH_ARTICLES = ("LAW", "DECREE", "CIRCULAR", "RESOLUTION", "CONSOLIDATED", "HISTORICAL")
ABOVE = {"CLAUSE": "ARTICLE", "POINT": "CLAUSE"}


def _none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def _said(c: Column) -> Column:
    """A condition that holds only where it is known to."""
    return F.coalesce(c, F.lit(False))


def resolver_violations(candidates: DataFrame, records: DataFrame, exported: DataFrame, evidence: DataFrame, overrides: DataFrame, known: tuple[str, ...], code_errors: tuple[str, ...]) -> DataFrame:
    """gate, id, n for each violation of the resolver's gates; n counts repeated rows beyond the first.

    candidates: candidate_id, record_id, role, requested_url, final_url, state, reason_codes, parent_candidate_id, allowed
    (whether a provider serves that address in that role), required, and meta, a struct of what its stored metadata says
    of role, requested_url, final_url, state and reason_codes; overrides: id, problems.
    """
    c = F.col
    codes = F.coalesce("reason_codes", F.array().cast("array<string>"))
    stored = F.coalesce("meta.reason_codes", F.array().cast("array<string>"))
    drift = F.array_sort(codes) != F.array_sort(stored)
    for name in ("role", "requested_url", "final_url", "state"):
        drift = drift | (F.coalesce(c(f"meta.{name}"), F.lit("")) != F.coalesce(c(name), F.lit("")))
    fetched = c("state") == "FETCHED"
    has = lambda *wanted: F.arrays_overlap(codes, F.array(*map(F.lit, wanted)))
    exact = c("state") == "AUTO_EXACT_SHA"
    page = F.lower(F.split_part("final_binary_url", F.lit("?"), F.lit(1)))

    def of(gate: str, rows: DataFrame, test: Column, key: str, n: Column | None = None) -> DataFrame:
        return rows.filter(_said(test)).select(F.lit(gate).alias("gate"), c(key).cast("string").alias("id"), (F.lit(1) if n is None else n).cast("long").alias("n"))

    own = candidates.select(c("record_id"), c("candidate_id").alias("binary_candidate_id"), F.lit(True).alias("own")).distinct()
    parents = candidates.select(c("candidate_id").alias("parent_candidate_id")).distinct()
    again = lambda rows, key: rows.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1").withColumn("id", F.concat_ws("|", *key))
    true = F.lit(True)
    parts = [
        of("candidate_column_metadata_mismatches", candidates, drift, "candidate_id"),
        of("identity_or_status_mismatch_saved_as_fetched", candidates, fetched & c("role").isin("IDENTITY", "STATUS_HISTORY") & has(*WRONG_PAGE), "candidate_id"),
        of("home_shell_saved_as_fetched", candidates, fetched & (has("VBPL_HOME_SHELL") | F.array_contains(stored, "VBPL_HOME_SHELL")), "candidate_id"),
        of("html_final_binary_urls", exported, page.endswith(".htm") | page.endswith(".html"), "record_id"),
        of("auto_exact_without_authority", exported, exact & ~c("binary_authority_verified"), "record_id"),
        of("auto_exact_without_identity", exported, exact & ~_said(c("identity_match") == "YES"), "record_id"),
        of("best_binary_field_mismatches", exported.join(own, ["record_id", "binary_candidate_id"], "left"), ~_none(c("binary_candidate_id")) & c("own").isNull(), "record_id"),
        of("conflicting_sha_semantics", exported, (c("resolved_sha_match") == "NO") & _none(c("resolved_downloaded_sha256")), "record_id"),
        of("blocking_reasons_from_satisfied_alternatives", exported, c("resolved_sha_match").isin("YES", "NO") & (F.size("blocking_reason_codes") > 0), "record_id"),
        of("browser_derived_orphans", candidates.filter(~_none(c("parent_candidate_id"))).join(parents, "parent_candidate_id", "left_anti"), true, "candidate_id"),
        of("duplicate_candidates", again(candidates, ["record_id", "role", "requested_url"]), true, "id", c("k") - 1),
        of("duplicate_evidence_events", again(evidence, ["evidence_id"]), true, "id", c("k") - 1),
        of("invalid_override_entries", overrides, F.size("problems") > 0, "id"),
        of("provider_role_route_violations", candidates, c("role").isin("IDENTITY", "BINARY", "STATUS_HISTORY") & ~_said(c("allowed")) & ~((c("state") == "BLOCKED") & has("PROVIDER_NOT_ALLOWED")), "candidate_id"),
        of("unclassified_reason_codes", candidates, F.exists(codes, lambda x: ~reason_known(x, known)), "candidate_id"),
        of("resolver_code_errors", candidates, has(*code_errors), "candidate_id"),
        of("nonterminal_records", records, ~_said(c("state").isin(*TERMINAL)), "record_id"),
        of("required_candidates_pending", candidates, c("required") & c("state").isin("DISCOVERED", "FETCH_PENDING"), "candidate_id"),
    ]
    return together(parts)


def verdicts(violations: DataFrame, gates: tuple[str, ...]) -> DataFrame:
    """gate, ordinal, observed, expected, passed for every gate, violated or not."""
    counted = violations.groupBy("gate").agg(F.sum("n").alias("observed"))
    every = violations.sparkSession.createDataFrame(list(enumerate(gates)), "ordinal int, gate string")
    seen = F.coalesce("observed", F.lit(0)).cast("long")
    return every.join(counted, "gate", "left").select("gate", "ordinal", seen.alias("observed"), F.lit(0).cast("long").alias("expected"), (seen == 0).alias("passed"))


def build_issues(registry: DataFrame, extracted: DataFrame, provisions: DataFrame, nodes: DataFrame, edges: DataFrame, short: int = 100, low: int = 1200) -> DataFrame:
    """severity, type, id, detail: what is wrong with a build's documents, provisions and edges."""
    c, true = F.col, F.lit(True)
    docs = registry.join(extracted.select("file_id", "text_chars"), "file_id", "left").withColumn("text_chars", F.coalesce("text_chars", F.lit(0)))
    legal, d = c("source_group") == "LEGAL_DOCUMENT", c("document_id")
    parsed = provisions.select("document_id").distinct()
    parent = provisions.select(c("provision_id").alias("parent_id"), c("level").alias("parent_level"), c("document_id").alias("parent_document")).distinct()
    placed = provisions.join(registry.select("document_id", F.lit(True).alias("known")).distinct(), "document_id", "left").join(parent, "parent_id", "left")
    expected = F.coalesce(*[F.when(c("level") == level, above) for level, above in ABOVE.items()])
    right = c("known") & (((c("level") == "ARTICLE") & (c("parent_id") == d)) | ((c("parent_level") == expected) & (c("parent_document") == d)))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("node"))
    dangling = ends.join(nodes.select(c("id").alias("node")), "node", "left_anti").select("id").distinct()
    twice = lambda rows, key: repeated(rows, [key])
    return together(
        [
            issue(docs, c("text_chars") < short, "ERROR", "NO_MACHINE_TEXT", d, c("text_chars")),
            issue(docs, c("text_chars").between(short, low - 1), "WARN", "LOW_MACHINE_TEXT", d, c("text_chars")),
            issue(docs, legal & _none(c("document_number")), "WARN", "MISSING_DOCUMENT_NUMBER", d),
            issue(docs, legal & _none(c("effective_from")), "WARN", "MISSING_EFFECTIVE_FROM", d),
            issue(docs, legal & (_none(c("status")) | (c("status") == "UNKNOWN")), "WARN", "UNKNOWN_LEGAL_STATUS", d),
            issue(twice(registry, "document_id"), true, "ERROR", "DUPLICATE_DOCUMENT_ID", d, c("n")),
            issue(twice(provisions, "provision_id"), true, "ERROR", "DUPLICATE_PROVISION_ID", c("provision_id"), c("n")),
            issue(placed, ~_said(right), "ERROR", "INVALID_PROVISION_PARENT", c("provision_id")),
            issue(provisions, _none(c("provision_identity_id")), "ERROR", "MISSING_PROVISION_IDENTITY", c("provision_id")),
            issue(provisions, _said(c("provenance_status") == "UNRESOLVED"), "ERROR", "UNRESOLVED_PROVISION_PROVENANCE", c("provision_id")),
            issue(registry.filter(c("document_type").isin(*WITH_ARTICLES)).join(parsed, "document_id", "left_anti"), true, "ERROR", "NO_ARTICLE_PARSED", d),
            issue(dangling, true, "ERROR", "DANGLING_EDGE", c("id")),
        ]
    )


def semantic_issues(registry: DataFrame, provisions: DataFrame, segments: DataFrame, relations: DataFrame, nodes: DataFrame, units: DataFrame, threshold: float = 0.55) -> DataFrame:
    """severity, type, id, detail: metadata, dates, spans, relations and retrieval units that contradict themselves."""
    c, true, e = F.col, F.lit(True), "ERROR"
    docs = registry.filter(c("source_group").isin("LEGAL_DOCUMENT", "CONSOLIDATED"))
    d, p = c("document_id"), c("provision_id")
    day = {f: strict_date(c(f)) for f in DATE_FIELDS}
    parts = [issue(docs, _none(c(f)), e, f"MISSING_{f.upper()}", d) for f in REQUIRED_FIELDS]
    parts += [issue(docs, ~_said(c("metadata_verified")), e, "UNVERIFIED_METADATA", d), issue(docs, ~_said(c("temporal_verified")), e, "UNVERIFIED_TEMPORAL_METADATA", d)]
    parts += [issue(docs, ~_none(c(f)) & day[f].isNull(), e, "INVALID_DATE", d, F.lit(f)) for f in DATE_FIELDS]
    parts += [
        issue(docs, _said(day["effective_to"] <= day["effective_from"]), e, "TEMPORAL_CONTRADICTION", d),
        issue(docs, _said(day["valid_to"] <= day["valid_from"]), e, "TEMPORAL_VALIDITY_CONTRADICTION", d),
        issue(docs, (c("version_role") == "CONSOLIDATED") & _none(c("consolidation_as_of")), e, "MISSING_CONSOLIDATION_AS_OF", d),
    ]
    text_of = lambda f: F.coalesce(c(f).cast("string"), F.lit(""))
    parts += [issue(docs, text_of(a) != text_of(b), e, "TEMPORAL_ALIAS_MISMATCH", d, F.lit(a)) for a, b in (("effective_from", "valid_from"), ("effective_to", "valid_to"))]
    parts += [issue(provisions, ~_said(c("segment_type") == "MAIN_BODY"), e, "NON_MAIN_BODY_PROVISION", p), issue(provisions, _none(c("canonical_path")), e, "MISSING_CANONICAL_PATH", p)]
    parts += [issue(repeated(provisions.filter(~_none(c("canonical_path"))), ["canonical_path"]), true, e, "DUPLICATE_CANONICAL_PATH", c("canonical_path"), c("n"))]
    unplaced = c("char_start").isNull() | c("char_end").isNull() | _none(c("segment_id"))
    parts += [issue(provisions, unplaced, e, "MISSING_PROVISION_PROVENANCE", p)]
    held = provisions.filter(~unplaced).join(segments.select("segment_id", c("text").alias("source")), "segment_id", "left")
    lines = lambda x: F.filter(F.transform(F.split(x, r"\r?\n"), lambda y: F.trim(y)), lambda y: y != "")
    inside = (c("char_start") >= 0) & (c("char_start") < c("char_end")) & (c("char_end") <= F.length("source"))
    same = lines(F.expr("substring(source, char_start + 1, char_end - char_start)")) == lines(c("text"))
    parts += [issue(held, ~_said(inside & same), e, "INVALID_PROVISION_PROVENANCE", p)]
    ends = relations.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("node"))
    parts += [
        issue(relations, c("confidence") < threshold, e, "RELATION_BELOW_THRESHOLD", c("edge_id"), c("confidence")),
        issue(ends.join(nodes.select(c("id").alias("node")), "node", "left_anti").select("edge_id").distinct(), true, e, "DANGLING_RELATION", c("edge_id")),
        issue(repeated(units, ["unit_id"]), true, e, "DUPLICATE_UNIT_ID", c("unit_id"), c("n")),
        issue(units, _none(c("breadcrumb")) | _none(c("provenance")) | _none(c("segment_type")), e, "INCOMPLETE_RETRIEVAL_METADATA", c("unit_id")),
    ]
    return together(parts)


def evidence_issues(rows: DataFrame, segments: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """type, id: the first thing wrong with each stored span, cut out again of its segment and of its document.

    rows: id, document_id, status, evidence, segment_id, segment_start, segment_end, document_start, document_end,
    page_start, page_end; sources: document_id, text; pages: document_id, page, text_start, text_end (may lack documents).
    """
    c = F.col
    at = rows.join(segments.select("segment_id", c("text").alias("segment_text")), "segment_id", "left").join(sources.select("document_id", c("text").alias("document_text")), "document_id", "left")
    touched = rows.select("id", "document_id", "document_start", "document_end").join(pages, "document_id").filter("text_start < document_end and text_end > document_start")
    met = touched.groupBy("id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    paged = pages.select("document_id", F.lit(True).alias("paged")).distinct()
    at = at.join(met, "id", "left").join(paged, "document_id", "left")
    cut = lambda text, a, b: F.expr(f"substring({text}, {a} + 1, {b} - {a})")
    problem = (
        F.when(~_said(c("status").isin("RESOLVED", "VERIFIED")), "UNRESOLVED_EVIDENCE")
        .when(c("segment_text").isNotNull() & ~_said(cut("segment_text", "segment_start", "segment_end") == c("evidence")), "INVALID_SEGMENT_EVIDENCE")
        .when(~_said(cut("document_text", "document_start", "document_end") == c("evidence")), "INVALID_DOCUMENT_EVIDENCE")
        .when(_said(c("paged")) & ~_said((c("page_start") == c("first_page")) & (c("page_end") == c("last_page"))), "INVALID_PAGE_EVIDENCE")
    )
    return at.select(problem.alias("type"), "id").filter("type is not null")


def readiness(problems: DataFrame, changes: DataFrame, versions: DataFrame, headings: DataFrame, build: DataFrame) -> DataFrame:
    """check, observed, passed: evidence, reviewed changes, changes applied to versions, reviewed intervals, headings with
    a source, and a graph load of the present build (build: build_id, loaded_id, load_passed, one row)."""
    c = F.col
    temporal = changes.filter(c("operation").isin("AMEND", "REPEAL", "REPLACE"))
    approved = _said(c("review_status") == "APPROVED") & ~_none(c("effective_from")) & ~_none(c("target_identity"))
    excluded = _said(c("review_status") == "EXCLUDED")
    pending = temporal.filter(~(approved | (excluded & ~_none(c("exclusion_reason")))))
    due = temporal.filter(approved & ~excluded)
    ended = versions.select(c("identity_id").alias("target_identity"), c("ended_by").alias("change_id"), c("valid_to").alias("effective_from"), F.lit(True).alias("ended")).distinct()
    begun = versions.select(c("identity_id").alias("target_identity"), c("introduced_by").alias("change_id"), c("valid_from").alias("effective_from"), F.lit(True).alias("begun")).distinct()
    key = ["target_identity", "change_id", "effective_from"]
    missed = due.join(ended, key, "left").join(begun, key, "left").filter(c("ended").isNull() | (c("operation").isin("AMEND", "REPLACE") & c("begun").isNull()))
    count = lambda name, rows: rows.agg(F.lit(name).alias("check"), F.count("*").alias("observed"))
    unreviewed = versions.agg(F.lit("reviewed_provision_intervals").alias("check"), F.when(F.count("*") == 0, 1).otherwise(F.count_if(~_said(c("verified")))).alias("observed"))
    stale = build.agg(F.lit("current_graph_build").alias("check"), F.when(F.count_if(_said(c("load_passed") & (c("loaded_id") == c("build_id")))) == 1, 0).otherwise(1).alias("observed"))
    parts = [count("exact_evidence", problems), count("reviewed_temporal_changes", pending), count("changes_applied_to_versions", missed), unreviewed, count("hierarchy_provenance", headings.filter(~_said(c("provenance_status") == "RESOLVED"))), stale]
    return together([p.select("check", c("observed").cast("long").alias("observed")) for p in parts]).withColumn("passed", c("observed") == 0)
