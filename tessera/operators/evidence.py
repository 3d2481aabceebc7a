"""Evidence: locating phrases, span checks, audits, coverage of slots, compression and the answer's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import missing, overlap, tokens
from tessera.operators.relational import greedy_budget

#: Labels in square brackets that count as citation markers.
MARKER_SHAPE = r"(?i)^(?:prov|case|diag|unit|article)[_ -][A-Za-z0-9_-]+$"


def flexible_pattern(phrase: Column) -> Column:
    """A case-insensitive pattern of a phrase's words with any white space between them."""
    escaped = F.regexp_replace(F.trim(phrase), r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.concat(F.lit("(?iu)"), F.regexp_replace(escaped, r"\s+", r"\\s+"))


def locate(text: Column, phrase: Column) -> dict[str, Column]:
    """status (RESOLVED for one match, AMBIGUOUS for more, UNRESOLVED), start (code points), evidence (the source's own
    words), n_matches."""
    usable = F.length(F.trim(phrase)) > 0
    pattern = flexible_pattern(phrase)
    n = F.when(usable, F.regexp_count(text, pattern)).otherwise(0)
    one = n == 1
    return {
        "n_matches": n,
        "status": F.when(one, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNRESOLVED"),
        "start": F.when(one, F.regexp_instr(text, pattern) - 1),
        "evidence": F.when(one, F.regexp_substr(text, pattern)),
    }


def exact_spans(pairs: DataFrame, inner: str, outer: str) -> DataFrame:
    """pairs with start and span_status: RESOLVED where the outer text holds the inner one exactly once."""
    first = F.expr(f"instr(`{outer}`, `{inner}`)")
    again = F.expr(f"locate(`{inner}`, `{outer}`, instr(`{outer}`, `{inner}`) + 1)")
    once = (F.length(inner) > 0) & (first > 0) & (again == 0)
    return pairs.withColumn("start", F.when(once, first - 1)).withColumn("span_status", F.when(once, "RESOLVED").otherwise("UNRESOLVED"))


def applicable(text: Column, query: Column, exact: Column, issue_match: Column) -> Column:
    """Exact hits, and texts that share a word of more than three letters with the query and match its issue."""
    return exact | ((overlap(F.array_distinct(tokens(query, 4)), F.array_distinct(tokens(text, 1))) > 0) & issue_match)


def audit(items: DataFrame) -> DataFrame:
    """items with issues, warnings and verified. Expects the unit's, node's and catalog's columns joined in (null where
    missing): unit_known, node_known, unit_url, item_url, catalog_known, catalog_url, catalog_status, kind, char_start,
    char_end, has_span, structure_equal, query_date, provision_verified, temporal_verified, valid_from, valid_to."""
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    dated, reviewed = c("query_date").isNotNull(), no(c("provision_verified"))
    usable = reviewed | no(c("temporal_verified"))
    holds = no((c("valid_from") <= c("query_date")) & (c("valid_to").isNull() | (c("query_date") < c("valid_to"))))
    issues = missing(
        {
            "UNKNOWN_UNIT_ID": ~no(c("unit_known")),
            "UNKNOWN_DOCUMENT_NODE": ~no(c("node_known")),
            "SOURCE_URL_NOT_FROM_UNIT": no(c("unit_known")) & ~c("item_url").eqNullSafe(c("unit_url")),
            "SOURCE_NOT_IN_CATALOG": ~no(c("catalog_known")),
            "SOURCE_URL_NOT_FROM_CATALOG": no(c("catalog_known")) & c("catalog_url").isNotNull() & ~c("item_url").eqNullSafe(c("catalog_url")),
            "MISSING_SOURCE_SPAN": no(c("kind") == "PROVISION") & ~no(c("has_span")),
            "INVALID_SOURCE_SPAN": no(c("char_end") < c("char_start")),
            "GRAPH_STRUCTURE_MISMATCH": no(c("unit_known")) & ~no(c("structure_equal")),
            "UNREVIEWED_PROVISION_INTERVAL": dated & ~usable,
            "WRONG_VERSION": dated & usable & ~holds,
        }
    )
    unverified = no(c("catalog_known")) & (c("catalog_url").isNull() | c("item_url").eqNullSafe(c("catalog_url"))) & ~no(c("catalog_status") == "VERIFIED")
    warnings = missing({"SOURCE_CATALOG_RECORD_UNVERIFIED": unverified, "DOCUMENT_LEVEL_TEMPORAL_FALLBACK": dated & usable & holds & ~reviewed})
    return items.withColumn("issues", issues).withColumn("warnings", warnings).withColumn("verified", F.size("issues") == 0)


def markers(answer: Column, known: Column) -> Column:
    """Distinct bracketed labels that are known ids or have the shape of one."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))
    return F.filter(found, lambda m: F.array_contains(known, m) | m.rlike(MARKER_SHAPE))


def reference_audit(answers: DataFrame) -> DataFrame:
    """answers (answer, verified_ids, cited_ids, claims array<struct<claim_id, evidence_ids>>) with problems and ok."""
    known, cited = F.col("verified_ids"), F.col("cited_ids")
    out = answers.withColumn("__m", markers(F.col("answer"), known))
    m = F.col("__m")
    flag = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    unsupported = F.transform(F.array_sort(F.array_except(m, known)), lambda x: F.concat(F.lit("UNSUPPORTED_CITATION:"), x))
    bare = F.transform(F.filter("claims", lambda c: F.size(c["evidence_ids"]) == 0), lambda c: F.concat(F.lit("CLAIM_WITHOUT_EVIDENCE:"), c["claim_id"]))
    beyond = F.transform(F.filter("claims", lambda c: F.size(F.array_except(c["evidence_ids"], known)) > 0), lambda c: F.concat(F.lit("CLAIM_UNSUPPORTED:"), c["claim_id"]))
    problems = F.concat(flag(F.size(m) == 0, "ANSWER_HAS_NO_EVIDENCE_MARKERS"), unsupported, flag(F.size(F.array_except(cited, known)) > 0, "CITATION_NOT_VERIFIED"), flag(F.size(F.array_except(cited, m)) > 0, "CITATION_NOT_MARKED"), bare, beyond)
    return out.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0).drop("__m")


def coverage(slots: DataFrame, by: str) -> DataFrame:
    """by, coverage (1 for FOUND_VERIFIED, .5 for FOUND, over mandatory slots), gaps (mandatory and not verified)."""
    state, mandatory = F.col("state"), F.col("mandatory")
    credit = F.when(state == "FOUND_VERIFIED", 1.0).when(state == "FOUND", 0.5).otherwise(0.0)
    n = F.count_if(mandatory)
    share = F.when(n > 0, F.sum(F.when(mandatory, credit).otherwise(0.0)) / n).otherwise(0.0)
    gaps = F.array_sort(F.collect_set(F.when(mandatory & (state != "FOUND_VERIFIED"), F.col("slot"))))
    return slots.groupBy(by).agg(F.round(share, 6).alias("coverage"), gaps.alias("gaps"))


def answer_state(conflicting: Column, missing_facts: Column, n_verified: Column, covered: Column, gaps: Column, minimum: float = 0.5) -> Column:
    """The ladder of an answer's states."""
    return (
        F.when(missing_facts > 0, "NEED_MORE_FACTS")
        .when(conflicting, "CONFLICTING_EVIDENCE")
        .when((n_verified > 0) & (gaps == 0), "SUFFICIENT")
        .when((n_verified > 0) & (covered >= minimum), "PARTIAL_ALLOWED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def compress(text: Column, query: Column, budget: int = 700, critical: tuple[str, ...] = ()) -> Column:
    """The lines of a text that fit a budget of characters: by shared words, plus two for a critical term, in order."""
    lines = F.filter(F.split(text, r"\n+"), lambda s: F.trim(s) != "")
    asked = F.array_distinct(tokens(query, 4))

    def score(line: Column) -> Column:
        low, extra = F.lower(line), F.lit(False)
        for term in critical:
            extra = extra | low.contains(term)
        return overlap(asked, F.array_distinct(tokens(line, 4))) + 2 * extra.cast("int")

    def pick(all_lines: Column) -> Column:
        scored = F.transform(all_lines, lambda x, i: F.struct(i.alias("position"), score(x).alias("score"), F.length(x).alias("size")))
        return F.transform(greedy_budget(scored, budget), lambda i: F.get(all_lines, i))

    return F.array_join(F.transform(F.array(lines), pick)[0], "\n")


def citation_text(c: dict[str, Column]) -> Column:
    """`point p, clause c, article a, number` from the parts that are there."""
    part = lambda word, col: F.when(col.isNotNull() & (col != ""), F.concat(F.lit(word + " "), col))
    return F.concat_ws(", ", part("điểm", c["point"]), part("khoản", c["clause"]), part("Điều", c["article"]), c["number"])


def occurrences(docs: DataFrame, doc: str, text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """doc, item, n (matches that don't overlap), first (position from 0): passages that stand in a text as they are.

    Candidates meet on keys, so that documents and passages are never multiplied. A passage may begin and end within a
    word, so its key is of its inner words, three at most; one without an inner word meets on its first characters, three
    at most. Only kinds of keys that some passage needs are made of the documents. Null and empty passages and null texts
    find nothing; repeated passages and documents count once each time with the same result.
    """
    words = F.split("phrase", r"\s+")
    inner = F.greatest(F.lit(0), F.least(F.lit(3), F.size(words) - 2))
    asked = passages.select(F.col(item).alias("item"), F.col(passage).alias("phrase")).filter("phrase <> ''").distinct()
    key = F.when(inner > 0, F.array_join(F.slice(words, F.lit(2), inner), " ")).otherwise(F.substring("phrase", 1, 3))
    kind = F.when(inner > 0, inner).otherwise(-F.least(F.lit(3), F.length("phrase")))
    asked = asked.select("item", "phrase", kind.cast("int").alias("kind"), F.xxhash64(kind.cast("int"), key).alias("key"))
    kinds = [r["kind"] for r in asked.select("kind").distinct().collect()]  # six at most

    def keys(kind: int) -> Column:
        made = F.col("words") if kind > 0 else F.col("own")
        joined = (lambda i: F.array_join(F.slice("words", i, F.lit(kind)), " ")) if kind > 0 else (lambda i: F.substring(F.col("own"), i, F.lit(-kind)))
        n = (F.size(made) if kind > 0 else F.length(made)) - (abs(kind) - 1)
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.lit(kind), joined(i))))).otherwise(F.array().cast("array<long>"))

    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("own")).filter("own is not null").distinct()
    split = own.select("doc", "own", F.split("own", r"\s+").alias("words"))
    made = F.concat(*[keys(k) for k in sorted(kinds)]) if kinds else F.array().cast("array<long>")
    met = split.select("doc", F.explode(made).alias("key")).join(asked, "key").select("doc", "item", "phrase").distinct()
    found = met.join(own, "doc").filter(F.col("own").contains(F.col("phrase"))).distinct()
    n = F.floor((F.length("own") - F.length(F.replace("own", F.col("phrase"), F.lit("")))) / F.length("phrase")).cast("int")
    return found.select(F.col("doc").alias(doc), F.col("item").alias(item), n.alias("n"), F.expr("instr(own, phrase) - 1").cast("long").alias("first"))
