"""Corpus building over tables: registry, cases, citations and relations, retrieval units, review inputs."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import legal as G
from tessera.functions.text import compact_upper, missing, stable_id
from tessera.operators.patterns import phrase_matches
from tessera.operators.relational import best_unless_tied, unique_match

#: First words of lines that name an issuer.
ISSUERS = [
    ("QUỐC HỘI", "Quốc hội"),
    ("ỦY BAN THƯỜNG VỤ QUỐC HỘI", "Ủy ban Thường vụ Quốc hội"),
    ("CHÍNH PHỦ", "Chính phủ"),
    ("BỘ LAO ĐỘNG", "Bộ Lao động - Thương binh và Xã hội"),
    ("BỘ NỘI VỤ", "Bộ Nội vụ"),
    ("HỘI ĐỒNG THẨM PHÁN", "Hội đồng Thẩm phán TANDTC"),
    ("BẢO HIỂM XÃ HỘI VIỆT NAM", "Bảo hiểm xã hội Việt Nam"),
]
#: Lines that name an instrument, that belong to its body, that end a title, and attachments.
TITLE_LINE = r"^(BỘ LUẬT|LUẬT|NGHỊ ĐỊNH|THÔNG TƯ|NGHỊ QUYẾT|VĂN BẢN HỢP NHẤT)(?:\s|$)"
BODY_LINE = r"(?iu)^(Căn cứ|Điều\s+\d)"
TITLE_STOP = r"(?iu)^(Căn cứ|Điều|Số:|\(?Ban hành kèm)"
ATTACHED = r"(?iu)ban hành kèm theo"
#: Where a head ends, how a court's name begins, and names of files of cases.
HEAD_END = r"(?iu)Căn cứ|Điều\s+1(?![\p{L}\p{N}_])"
COURTS = ("TÒA ÁN NHÂN DÂN", "TOÀ ÁN NHÂN DÂN")
CASE_FILE = r"(?iu)(\d{1,4})[-/](\d{4})[-/]((?:LĐ|LD)[A-ZĐ-]*|AL)(?:$|[_. ])"
#: Markers of a judgment's sections.
SECTION_MARKERS = {"facts": ["NỘI DUNG VỤ ÁN", "NỘI DUNG VỤ VIỆC"], "reasoning": ["NHẬN ĐỊNH CỦA TÒA ÁN", "NHẬN ĐỊNH CỦA TOÀ ÁN"], "decision": ["QUYẾT ĐỊNH"]}
#: Operative wording and the relation it makes.
OPERATIVE = [("AMENDS", r"(?iu)^\s*(?:(?:Điều\s+\d+[a-zđ]?|\d+)[.)]\s*)?Sửa đổi"), ("REPEALS", r"(?iu)^\s*(?:(?:Điều\s+\d+[a-zđ]?|\d+)[.)]\s*)?Bãi bỏ"), ("REPLACES", r"(?iu)^\s*(?:(?:Điều\s+\d+[a-zđ]?|\d+)[.)]\s*)?(?:(?:Văn bản|Nghị định|Thông tư) này\s+)?thay thế"), ("IMPLEMENTS", r"(?iu)^\s*(?:(?:Điều\s+\d+[a-zđ]?|\d+)[.)]\s*)?(?:(?:Văn bản|Nghị định|Thông tư) này\s+)?(?:quy định chi tiết|hướng dẫn thi hành)")]
#: Confidence by how a reference's document was found.
CONFIDENCE = {"explicit_instrument_number": 0.98, "curated_alias": 0.95, "same_instrument": 0.93}


def lines_of(text: Column, within: int) -> Column:
    return F.filter(F.transform(F.split(F.substring(text, 1, within), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def _before(lines: Column, pattern: str) -> Column:
    """The lines before the first one that the pattern finds."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")
    return F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)


def title_of(text: Column, filename: Column) -> Column:
    """The line that names the instrument, before preamble and articles and not as an attachment, and up to three after it;
    else the file's name."""

    def build(lines: Column) -> Column:
        names = F.transform(_before(lines, BODY_LINE), lambda x: x.rlike(TITLE_LINE) & ~x.rlike(ATTACHED))
        at = F.array_position(names, True).cast("int")
        kept = _before(F.slice(lines, at + 1, F.lit(3)), TITLE_STOP)
        return F.when(at > 0, F.substring(F.array_join(F.concat(F.slice(lines, F.greatest(at, F.lit(1)), F.lit(1)), kept), " "), 1, 350))

    found = F.transform(F.array(lines_of(text, 6000)), build)[0]
    return F.coalesce(found, F.replace(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def issuer_from_text(text: Column) -> Column:
    """The issuer of the first head line that begins with one, longer names before shorter, or the name of a court; the head
    are the first 25 lines before preamble and first article."""
    lead = lambda names, up: functools.reduce(operator.or_, [up.startswith(n) for n in names])

    def of(line: Column) -> Column:
        up, out = F.upper(line), F
        for name, issuer in sorted(ISSUERS, key=lambda x: -len(x[0])):
            out = out.when(up.startswith(name), issuer)
        return out.when(lead(COURTS, up), line)

    head = F.get(F.split(F.substring(text, 1, 3000), HEAD_END, 2), F.lit(0))
    lines = F.transform(F.slice(F.split(head, r"\r?\n"), 1, 25), lambda x: F.trim(x))
    return F.get(F.array_compact(F.transform(lines, of)), F.lit(0))


def case_number(filename: Column, text: Column) -> Column:
    part = lambda i: F.regexp_extract(filename, CASE_FILE, i)
    head = F.regexp_extract(F.substring(text, 1, 1200), r"(?imu)^\s*(?:Bản án|Quyết định|Án lệ)(?:\s+số)?\s*:?\s*(\d+/\d{4}/[A-ZĐ-]+)", 1)
    return F.upper(F.coalesce(F.when(part(1) != "", F.concat_ws("/", part(1), part(2), part(3))), F.when(head != "", head)))


def registry(docs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One record per document (file_id, relative_path, filename, text, sha256, source_group, document_type_hint).

    Numbers come from file names, dates from the instrument's own commencement clause; consolidations take neither
    from their text. overrides: relative_path and columns that replace what was inferred.
    """
    c = F.col
    legal = c("source_group").isin("LEGAL_DOCUMENT", "CONSOLIDATED")
    original = legal & (c("document_type_hint") != "CONSOLIDATED")
    out = docs.withColumn("document_id", stable_id("doc", c("sha256"), c("relative_path")))
    out = out.withColumn("document_number", F.when(original, G.document_number(c("filename"), c("text"))))
    out = out.withColumn("case_number", F.when(c("source_group") == "JUDICIAL", case_number(c("filename"), c("text"))))
    out = out.withColumn("effective_from", F.when(original, G.effective_date(c("text"))))
    out = out.withColumn("title", title_of(c("text"), c("filename")))
    out = out.withColumn("issuer", F.coalesce(issuer_from_text(c("text")), F.when(legal, G.issuer_of(c("document_number")))))
    out = out.withColumn("instrument_type", F.when(legal, F.coalesce(G.instrument_kind(c("document_number")), F.lit("UNKNOWN"))).otherwise("NOT_APPLICABLE"))
    out = out.withColumn("authority_rank", F.when(legal, 100).when(c("source_group") == "JUDICIAL", 50).otherwise(10))
    out = out.withColumn("instrument_id", F.when(legal, stable_id("instrument", F.coalesce(F.upper(c("document_number")), F.concat(F.lit("UNRESOLVED:"), c("document_id"))))))
    if overrides is not None:
        names = [n for n in overrides.columns if n != "relative_path"]
        out = out.join(overrides.select("relative_path", *[c(n).alias("__o_" + n) for n in names]), "relative_path", "left")
        for n in names:
            out = out.withColumn(n, F.coalesce(c("__o_" + n), c(n)))
        out = out.drop(*["__o_" + n for n in names])
    return out


def case_sections(text: Column) -> dict[str, Column]:
    """facts, reasoning, decision: what stands between the sections' markers, in whatever order they come; without any
    marker everything is facts. Upper-casing must keep lengths, as it does for Vietnamese."""
    up = F.upper(text)
    marks = []
    for key, names in SECTION_MARKERS.items():
        at = F.coalesce(*[F.when(F.instr(up, n) > 0, F.struct(F.instr(up, n).alias("at"), F.lit(key).alias("key"), F.lit(len(n)).alias("size"))) for n in names])
        marks.append(at)
    found = F.array_sort(F.array_compact(F.array(*marks)))

    def piece(key: str) -> Column:
        def cut(ms: Column) -> Column:
            i = F.array_position(F.transform(ms, lambda m: m["key"]), key).cast("int")
            here, after = F.get(ms, i - 1), F.get(ms, i)
            start = here["at"] + here["size"]
            return F.when(i > 0, F.regexp_replace(F.substring(text, start, F.coalesce(after["at"], F.length(text) + 1) - start), r"^\s+|\s+$", ""))

        whole = F.when(F.size(found) == 0, text if key == "facts" else F.lit(""))
        return F.coalesce(F.transform(F.array(found), cut)[0], whole, F.lit(""))

    return {k: piece(k) for k in SECTION_MARKERS}


def citations(sources: DataFrame, documents: DataFrame, provisions: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row per reference in sources (source_id, text, owner: the document it stands in, null for cases): method,
    status, target_id, confidence.

    A document is found by its stated number, by a curated alias in the text (aliases: alias, document_id), or as the
    source's own. Only a target that is the one match of its whole path counts; a source never cites itself.
    """
    refs = sources.select("source_id", "owner", "text", F.posexplode(G.references(F.col("text"))).alias("n", "r")).select("source_id", "owner", "text", "n", "r.*")
    numbered = best_unless_tied(documents.filter("document_number is not null").select(compact_upper(F.col("document_number")).alias("number"), "document_id", "authority_rank"), ["number"], "authority_rank", "document_id")
    refs = refs.withColumn("number", F.when(F.col("instrument").isNotNull(), compact_upper(F.col("instrument"))))
    refs = refs.join(numbered.withColumnRenamed("document_id", "by_number"), "number", "left")
    bare = refs.filter("instrument is null").select(F.struct("source_id", "n").alias("ref"), "text")
    named = phrase_matches(bare, "ref", "text", aliases, "document_id", "alias").groupBy("ref").agg(F.min("document_id").alias("by_alias"), F.count_distinct("document_id").alias("k"))
    named = named.filter("k = 1").select("ref.source_id", "ref.n", "by_alias")
    refs = refs.join(named, ["source_id", "n"], "left")
    method = F.when(F.col("instrument").isNotNull(), "explicit_instrument_number").when(F.col("by_alias").isNotNull(), "curated_alias").when(F.col("owner").isNotNull(), "same_instrument").otherwise("unresolved")
    document = F.when(F.col("instrument").isNotNull(), F.col("by_number")).otherwise(F.coalesce("by_alias", "owner"))
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    refs = refs.withColumns({"method": method, "document_id": document, "a": low("article"), "c": low("clause"), "p": low("point")})
    paths = provisions.select("document_id", low("article_number").alias("a"), low("clause_number").alias("c"), low("point_number").alias("p"), F.col("provision_id").alias("target_id"))
    out = unique_match(refs, paths, ["document_id", "a", "c", "p"], "target_id")
    out = out.filter(F.col("target_id").isNull() | (F.col("target_id") != F.col("source_id")))
    sure = F.coalesce(*[F.when(F.col("method") == m, F.lit(v)) for m, v in CONFIDENCE.items()], F.lit(0.0))
    hit = F.col("target_id").isNotNull()
    return out.select("source_id", "n", "article", "clause", "point", "instrument", "method", "target_id", "owner", "text", F.when(hit, sure).otherwise(0.0).alias("confidence"), F.when(hit, "RESOLVED").otherwise("UNRESOLVED").alias("status"))


def relation_edges(cited: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Edges of resolved citations at or above the threshold: CITES from cases, REFERENCES else, and the operative
    relation where the source's text begins with operative wording (confidence .82)."""
    rows = cited.filter((F.col("status") == "RESOLVED") & (F.col("confidence") >= threshold))
    plain = rows.select("source_id", "target_id", F.when(F.col("owner").isNull(), "CITES").otherwise("REFERENCES").alias("type"), "confidence")
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(t)) for t, p in OPERATIVE])
    acting = rows.filter(F.lit(0.82) >= threshold).select("source_id", "target_id", kind.alias("type"), F.lit(0.82).alias("confidence")).filter("type is not null")
    edges = plain.unionByName(acting).groupBy("source_id", "target_id", "type").agg(F.max("confidence").alias("confidence"))
    return edges.withColumn("edge_id", stable_id("edge", F.col("source_id"), F.col("target_id"), F.col("type")))


def retrieval_units(provisions: DataFrame, documents: DataFrame, minimum: int = 20) -> DataFrame:
    """unit_id, text, breadcrumb, ancestor_context and the document's metadata for provisions of enough length.

    Levels are three, so an ancestor's text is two joins away; 1500 characters of each ancestor are kept.
    """
    up = provisions.select(F.col("provision_id").alias("parent_id"), F.col("text").alias("up_text"), F.col("parent_id").alias("up_parent"))
    top = provisions.select(F.col("provision_id").alias("up_parent"), F.col("text").alias("top_text"))
    rows = provisions.join(up, "parent_id", "left").join(top, "up_parent", "left").join(documents.select("document_id", "title", "document_number", "authority_rank"), "document_id", "left")
    part = lambda word, c: F.when(F.col(c) != "", F.concat(F.lit(word + " "), F.col(c)))
    crumb = F.concat_ws(" > ", "title", part("Điều", "article_number"), part("khoản", "clause_number"), part("điểm", "point_number"))
    context = F.concat_ws("\n", F.substring("top_text", 1, 1500), F.substring("up_text", 1, 1500))
    rows = rows.filter(F.length(F.trim("text")) >= minimum)
    return rows.select(F.col("provision_id").alias("unit_id"), F.concat_ws("\n", crumb, F.when(context != "", context), "text").alias("text"), F.col("text").alias("source_text"), crumb.alias("breadcrumb"), context.alias("ancestor_context"), "document_id", F.coalesce("document_number", F.lit("")).alias("document_number"), "article_number", "clause_number", "point_number", F.coalesce("authority_rank", F.lit(0)).alias("authority_rank"))


def change_problems(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """changes (change_id, kind, identity, date) with ok: some old version ends on the date, and for amendments and
    replacements some version starts on it."""
    ends = versions.select("identity", F.col("valid_to").alias("date"), F.lit(True).alias("ended")).distinct()
    starts = versions.select("identity", F.col("valid_from").alias("date"), F.lit(True).alias("started")).distinct()
    out = changes.join(ends, ["identity", "date"], "left").join(starts, ["identity", "date"], "left")
    new = ~F.col("kind").isin("AMEND", "REPLACE") | F.coalesce("started", F.lit(False))
    return out.withColumn("ok", F.coalesce("ended", F.lit(False)) & new).drop("ended", "started")


def reason_known(code: Column, known: tuple[str, ...]) -> Column:
    return code.isin(*known) | code.rlike(r"^HTTP_[1-5]\d\d$")


def reason_from_error(kind: Column, http: Column) -> Column:
    """A reason code for a failed fetch."""
    return F.when(http.isNotNull(), F.concat(F.lit("HTTP_"), http.cast("string"))).when(kind.isin("timeout", "connection", "dns"), "NETWORK_ERROR").when(kind == "decode", "ENCODING_ERROR").otherwise("FETCH_ERROR")


def home_page(url: Column, body: Column) -> Column:
    """Whether a fetched page is the site's front page instead of a document."""
    head = F.lower(F.substring(body, 1, 4000))
    return F.coalesce(url.rlike(r"^https?://[^/]+/?(?:home|index\.html?)?$"), F.lit(False)) | head.contains("trang chủ")


def override_problems(c: dict[str, Column], roles: tuple[str, ...]) -> Column:
    return missing({"BAD_ROLE": ~F.coalesce(c["role"].isin(*roles), F.lit(False)), "NOT_HTTPS": ~F.coalesce(c["url"].startswith("https://"), F.lit(False)), "NO_RECORD": F.coalesce(c["record_id"], F.lit("")) == ""})


def carried(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with nulls of `columns` filled from the last row before that has a value."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def checked_columns(df: DataFrame, allowed: set[str]) -> DataFrame:
    """df, or an error that names columns which aren't allowed."""
    unknown = sorted(set(df.columns) - allowed)
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return df


def search_query(identifier: str, title: str = "") -> str:
    """The words to look a document up by."""
    return re.sub(r"\s+", " ", f'"{identifier}" {title}').strip()
