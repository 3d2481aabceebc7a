"""Source resolution over tables: seeds, candidate URLs, a fetch log, and the states that follow from them.

Fetching itself is outside; its outcome comes in as a table with one row per candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import missing

#: Reasons that bar a file from being trusted.
UNTRUSTED = ("UNKNOWN_MAGIC", "MIME_MISMATCH", "TOO_LARGE")
#: Leading bytes of known file kinds.
MAGIC = [("25504446", "PDF"), ("504B0304", "ZIP"), ("D0CF11E0", "OLE")]
KNOWN_REASONS = ("SHA_MISMATCH", "IDENTITY_MISMATCH", "AUTHORITY_MISMATCH", "UNKNOWN_MAGIC", "MIME_MISMATCH", "TOO_LARGE", "NETWORK_ERROR", "FETCH_ERROR", "ENCODING_ERROR")


def record_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def initial_state(result: Column, urls: list[Column]) -> Column:
    """A seed's first state from how it was collected and whether it has any URL."""
    some = F.coalesce(*[F.when(u != "", u) for u in urls]).isNotNull()
    return F.when(result == "NOT_FOUND", "NEEDS_DISCOVERY").when(result == "MULTIPLE", "NEEDS_REVIEW").when(some, "FETCH_PENDING").otherwise("NEEDS_DISCOVERY")


def candidates(seeds: DataFrame, roles: list[tuple[str, str]], overrides: DataFrame | None = None) -> DataFrame:
    """record_id, role, url, ordinal, required: a row per non-empty URL column (role, column), then overrides; first of
    each (record, role, url); the first BINARY of a record is required."""
    made = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("url"), F.lit(i).alias("ordinal")) for i, (role, c) in enumerate(roles)])
    rows = seeds.select("record_id", F.explode(F.filter(made, lambda x: x["url"] != "")).alias("c")).select("record_id", "c.*")
    if overrides is not None:
        rows = rows.unionByName(overrides.select("record_id", "role", "url", (F.col("ordinal") + len(roles)).alias("ordinal")))
    w = Window.partitionBy("record_id", "role", "url").orderBy("ordinal")
    rows = rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    first = F.row_number().over(Window.partitionBy("record_id", "role").orderBy("ordinal")) == 1
    return rows.withColumn("required", (F.col("role") == "BINARY") & first)


def url_allowed(url: Column, role: Column, providers: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with provider: the first (by ordinal) whose host is the URL's or its parent domain, whose path pattern fits
    and whose role list holds the role; https only. Candidates meet on every parent domain of the host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = rows.withColumn("__k", F.monotonically_increasing_id())
    asked = keyed.filter(url.startswith("https://") & host.isNotNull()).select("__k", role.alias("__role"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")).alias("__path"), F.explode(F.array_distinct(domains)).alias("domain"))
    glob = F.concat(F.lit("^"), F.replace(F.regexp_replace("path_glob", r"([.+?^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    fits = asked.join(providers.withColumn("__glob", glob), "domain").filter(F.rlike(F.col("__path"), F.col("__glob")) & F.array_contains("roles", F.col("__role")))
    best = fits.groupBy("__k").agg(F.min_by("provider_id", "ordinal").alias("provider"))
    return keyed.join(best, "__k", "left").drop("__k")


def file_kind(content: Column) -> Column:
    lead, out = F.hex(F.substring(content, 1, 4)), None
    for magic, kind in MAGIC:
        out = F.when(lead == magic, kind) if out is None else out.when(lead == magic, kind)
    return out


def binary_reasons(content: Column, content_type: Column, sha: Column, expected_sha: Column, size: Column, max_bytes: int = 25 * 1024 * 1024) -> Column:
    """What is wrong with a fetched file."""
    kind = file_kind(content)
    clash = (kind == "PDF") & ~F.coalesce(content_type.contains("pdf") | content_type.contains("octet-stream"), F.lit(True))
    return missing({"TOO_LARGE": size > max_bytes, "UNKNOWN_MAGIC": kind.isNull(), "MIME_MISMATCH": F.coalesce(clash, F.lit(False)), "SHA_MISMATCH": F.coalesce((expected_sha != "") & (sha != expected_sha), F.lit(False))})


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def identity_matches(expected: Column, page: Column) -> Column:
    """The identifier stands in the page, as it is or with everything but letters and digits left out."""
    plain = F.lower(page).contains(F.lower(expected))
    return F.coalesce((F.length(expected) > 0) & (plain | compact(page).contains(compact(expected))), F.lit(False))


def trusted(kind: Column, reasons: Column, authority_ok: Column) -> Column:
    bad = F.arrays_overlap(reasons, F.array(*[F.lit(x) for x in UNTRUSTED]))
    return kind.isNotNull() & ~F.coalesce(bad, F.lit(False)) & authority_ok


def decide(authority_ok: Column, identity_ok: Column, has_binary: Column, sha_equal: Column, content_ok: Column, secondary: Column) -> Column:
    """A candidate's state."""
    return (
        F.when(secondary, "NEEDS_REVIEW")
        .when(~authority_ok, "BLOCKED_AUTHORITY")
        .when(~identity_ok, "NEEDS_REVIEW")
        .when(~has_binary, "BINARY_PENDING")
        .when(sha_equal, "AUTO_EXACT_SHA")
        .when(content_ok, "AUTO_CONTENT_MATCH")
        .otherwise("NEEDS_REVIEW")
    )


def best_candidate(rows: DataFrame, key: list[str]) -> DataFrame:
    """The winning row of each key: highest rank, then shorter provider name, then provider, url, id."""
    order = F.struct("rank", (-F.length("provider")).alias("short"), "provider", "url", "candidate_id")
    return rows.groupBy(*key).agg(F.max_by(F.struct("candidate_id", "provider", "url", "rank"), order).alias("best")).select(*key, "best.*")


def record_states(rows: DataFrame) -> DataFrame:
    """record_id, state, reasons from its candidates' states: exact beats content match, which beats blocking, review
    and pending; reasons are distinct and sorted."""
    has = lambda s: F.max((F.col("state") == s).cast("int")) == 1
    state = F.when(has("AUTO_EXACT_SHA"), "AUTO_EXACT_SHA").when(has("AUTO_CONTENT_MATCH"), "AUTO_CONTENT_MATCH").when(has("NEEDS_REVIEW"), "NEEDS_REVIEW").when(has("BLOCKED_AUTHORITY"), "BLOCKED_AUTHORITY").otherwise("FETCH_PENDING")
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons"))))
    return rows.groupBy("record_id").agg(state.alias("state"), reasons.alias("reasons"))
