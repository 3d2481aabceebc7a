"""Personal data by patterns, and what else gives a protected entity away, in DataFrame operations only.

The patterns find base spans. Every distinct base value is a protected entity. A term that stands near an entity
discloses it as far as their co-occurrence in the corpus says: with document counts n, PMI = log(n_et * N / (n_e * n_t))
against the entity's own information IC = log(N / n_e). From `generalise_at` * IC on a term is generalised to its kind,
from `remove_at` * IC on it is removed, wherever it stands in any text of the corpus. Chance
is kept out by a test of every pair that occurs: under independence, its co-occurrence count must be less likely than
`significance`, corrected for the number of pairs (Bonferroni; Chernoff's bound on the hypergeometric tail).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, written so that Java's engine takes linear time and no deep recursion: possessive groups where
#: nothing after them can match, and no start inside a run whose own start was tried. A card candidate is a whole run of
#: digits with single separators; the run has 16 to 19 digits or fails as a whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[\p{L}\p{N}]{2,}"
_TERM_SPLIT = r"[\p{L}\p{N}]{2,}+"
#: Hash functions that estimate how alike contexts are.
HASHES = 4
DEFAULTS = {"window_chars": 120, "significance": 0.05, "generalise_at": 0.7, "remove_at": 0.95}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _entity(kind: str, found: Column) -> Column:
    """One spelling for each entity."""
    if kind in ("card", "phone"):
        return F.regexp_replace(found, "[^0-9]", "")
    return F.lower(found)


def _lengths(parts: Column, n: Column) -> Column:
    return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))


def _spans(kind: str, text: Column) -> Column:
    """Spans of one kind: positions follow from the lengths of the matches and of what lies between them."""
    pattern = PATTERNS[kind]
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(x: Column) -> Column:
        start = lambda i: _lengths(x["between"], i + 1) + _lengths(x["found"], i)
        made = F.transform(x["found"], lambda m, i: F.struct(F.lit(kind).alias("kind"), start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("value")))
        return F.filter(made, lambda s: _valid(kind, s["value"]))

    hint = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}[kind]
    both = F.array(F.struct(between.alias("between"), found.alias("found")))
    return F.when(hint, F.transform(both, place)[0]).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _rebuild(text: Column, spans: Column, instead) -> Column:
    """text with each span replaced by instead(span, from where); what overlaps an earlier span only lengthens it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def step(a: Column, s: Column) -> Column:
        ahead = F.concat(a["out"], F.when(s["start"] > a["pos"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"])).otherwise(F.lit("")), instead(s, a["pos"]))
        return F.when(s["end"] <= a["pos"], a).otherwise(F.struct(ahead.alias("out"), s["end"].alias("pos")))

    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


def _blank(text: Column, spans: Column) -> Column:
    """text with spans as white space, of the same length."""
    return _rebuild(text, spans, lambda s, pos: F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], pos)))


def with_base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with __p_row (a key for the row) and __p_base (its base spans by kind, then start)."""
    out = df.withColumn("__p_row", F.monotonically_increasing_id()).withColumn("__p_text", F.coalesce(common.column(text_col), F.lit("")))
    out = out.withColumns({f"__p_{k}": _spans(k, F.col("__p_text")) for k in KINDS})
    return out.withColumn("__p_base", F.concat(*[F.col(f"__p_{k}") for k in KINDS])).drop("__p_text", *[f"__p_{k}" for k in KINDS])


def _document_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n_t: in how many texts each wanted term stands, over all texts.

    Words that can't be wanted are sorted out before the shuffle by the bitmap; the join after it is exact.
    """
    known = F.filter("terms", lambda w: common.in_bitmap(w, "__bits"))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(_TERM), F.lit(0)))
    rows = texts.select(common.bitmap(wanted, "term", "__bits"), terms.alias("terms")).select(F.explode(known).alias("term"))
    # an inner join: a semi join would be moved below the aggregate, where every single word would take part
    return rows.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")


def _log_tail(k: Column, drawn: Column, marked: Column, total: int) -> Column:
    """ln of Chernoff's bound on the chance of k or more marked texts among those drawn: -drawn * KL(k / drawn, marked / total)."""
    a, q = k / drawn, marked / F.lit(float(max(total, 1)))
    rest = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - q))).otherwise(F.lit(0.0))
    return F.when(a > q, -drawn * (a * F.log(a / q) + rest)).otherwise(F.lit(0.0))


def near_entities(marked: DataFrame, window_chars: int) -> DataFrame:
    """__p_row, entity, term, context: what stands within `window_chars` of an entity in rows (__p_row, text, __p_base);
    an empty term for the entity itself. `context` has the least hashes of the terms around, by HASHES functions."""
    text = F.col("text")
    masked = marked.select("__p_row", "__p_base", _blank(text, F.col("__p_base")).alias("text"))
    entity = F.concat_ws(":", F.col("s.kind"), F.coalesce(*[F.when(F.col("s.kind") == k, _entity(k, F.col("s.value"))) for k in KINDS]))
    near = masked.select("__p_row", "text", F.explode("__p_base").alias("s")).select(
        "__p_row",
        entity.alias("entity"),
        F.substring(text, F.greatest(F.lit(1), F.col("s.start") + 1 - window_chars), F.least(F.lit(window_chars), F.col("s.start"))).alias("left"),
        F.substring(text, F.col("s.end") + 1, F.lit(window_chars)).alias("right"),
        (F.col("s.start") > window_chars).alias("cut_left"),
        (F.length(text) > F.col("s.end") + window_chars).alias("cut_right"),
    )
    # a term cut by the window's edge isn't a whole one
    left = F.when(F.col("cut_left"), F.regexp_replace("left", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("left"))
    right = F.when(F.col("cut_right"), F.regexp_replace("right", r"[\p{L}\p{N}]+$", "")).otherwise(F.col("right"))
    whole = F.concat(left, F.lit(" "), right)
    near = near.select("__p_row", "entity", F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(_TERM), F.lit(0))).alias("terms"))
    least = [F.coalesce(F.array_min(F.transform("terms", lambda t, i=i: F.xxhash64(F.lit(i), t))), F.lit(0).cast("long")).alias(f"h{i}") for i in range(HASHES)]
    near = near.select("__p_row", "entity", *least, F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    near = near.groupBy("__p_row", "entity", "term").agg(*[F.min(f"h{i}").alias(f"h{i}") for i in range(HASHES)])
    return near.select("__p_row", "entity", "term", F.array(*[f"h{i}" for i in range(HASHES)]).alias("context"))


def _occurrences(near: DataFrame) -> DataFrame:
    """entity, term, n, k: in how many rows they occur, and in how many contexts, as if all were different.

    k = n^2 / (sum over all pairs of rows of the similarity of their contexts), which the least hashes estimate without
    making pairs: rows that share one. Copies of one passage count as one context or little more, also if some of their
    words differ; contexts that have nothing in common count fully.
    """
    alike = near.select("entity", "term", F.posexplode("context").alias("i", "h")).groupBy("entity", "term", "i", "h").agg(F.count("*").alias("c"))
    counted = alike.groupBy("entity", "term").agg(F.sum(F.when(F.col("i") == 0, F.col("c"))).alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("s"))
    return counted.select("entity", "term", "n", (F.col("n").cast("double") * F.col("n") * HASHES / F.col("s")).alias("k"))


def disclosing_pairs(near: DataFrame, texts: DataFrame, significance: float, generalise_at: float) -> DataFrame:
    """entity, term, strength, wide: the pairs that disclose, strength being PMI / IC; `wide` where also the pair's
    contexts, each counted as far as it differs from the others, are more than chance gives. near: a stored table of
    near_entities."""
    counted = common.materialize(_occurrences(near), "occurrences")
    pairs = counted.filter("term <> ''").select("entity", "term", F.col("n").alias("n_et"), F.col("k").alias("k_et"))
    n_e = counted.filter("term = ''").select("entity", F.col("n").alias("n_e"), F.col("k").alias("k_e"))
    n_t = _document_counts(texts, pairs.select("term").distinct())
    total = texts.count()
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_e"))
    n_both = F.least("n_et", "n_e", "n_t")
    pmi = F.log(n_both * float(max(total, 1)) / (F.col("n_e") * F.col("n_t")))
    strength = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    log_chance = F.least(_log_tail(n_both, F.col("n_e"), F.col("n_t"), total), _log_tail(n_both, F.col("n_t"), F.col("n_e"), total))
    in_contexts = _log_tail(F.col("k_et"), F.greatest("k_e", "k_et"), F.col("n_t"), total)
    least = math.log(significance) - math.log(max(pairs.count(), 1))
    scored = pairs.join(n_e, "entity").join(n_t, "term").select("entity", "term", strength.alias("strength"), (log_chance <= least).alias("local"), (in_contexts <= least).alias("wide"))
    return scored.filter((F.col("strength") >= generalise_at) & (F.col("local") | F.col("wide"))).drop("local")


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`."""
    return F.transform(F.array(value), body)[0]


def _word_spans(text: Column, wanted) -> Column:
    """(word, start, end) of the words for which wanted(lower-cased word) holds. Positions are running sums in two
    levels, so that the work stays near-linear in the length of a text, whose words never leave their row."""
    mark, block = "\uffff", 128  # the mark is no character of any text; where it stands nevertheless, it is no letter
    parts = F.arrays_zip(F.split(F.replace(text, F.lit(mark), F.lit(" ")), _TERM_SPLIT, -1).alias("gap"), F.regexp_extract_all(text, F.lit(_TERM_SPLIT), F.lit(0)).alias("word"))
    marked = F.array_join(F.transform(parts, lambda x: F.when(wanted(F.lower(x["word"])), F.concat(x["gap"], F.lit(mark), x["word"], F.lit(mark))).otherwise(F.concat(x["gap"], F.coalesce(x["word"], F.lit(""))))), "")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def place(pieces: Column) -> Column:  # every second piece is a wanted word
        def with_lengths(lengths: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))

            def with_starts(starts: Column) -> Column:
                def span(i: Column) -> Column:
                    at = F.floor(i / block).cast("int")
                    begin = F.get(starts, at) + total(F.slice(lengths, at * block + 1, i % block))
                    return F.struct(F.get(pieces, i).alias("word"), begin.alias("start"), (begin + F.get(lengths, i)).alias("end"))

                return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), span))

            return _let(_let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))), with_starts)

        return _let(F.transform(pieces, F.length), with_lengths)

    return _let(F.split(marked, mark, -1), place)


def _term_span(s: Column, remove: Column) -> Column:
    """The span of a word (word, start, end) that discloses."""
    general = F.when(s["word"].rlike("[0-9]"), "[NUMBER]").when(s["word"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    return F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(remove, F.lit("remove")).otherwise(general).alias("value"))


def term_spans(scanned: DataFrame, window_chars: int, significance: float, generalise_at: float, remove_at: float) -> DataFrame:
    """__p_row, __p_terms: the spans the method adds. scanned: stored rows with __p_row, text and __p_base. The kind is
    `term`, the value `remove` or what the term is generalised to.

    Terms of wide pairs go from every text. Terms of pairs that only copies of few contexts bear out go from the texts
    where they stand near their entity: copies would otherwise take ordinary words from the whole corpus.
    """
    near = common.materialize(near_entities(scanned.filter(F.size("__p_base") > 0), window_chars), "near-entities")
    pairs = common.materialize(disclosing_pairs(near, scanned.select("text"), significance, generalise_at), "disclosing")
    terms = pairs.groupBy("term").agg(F.max("strength").alias("strength"), F.max("wide").alias("wide"))
    wide = common.materialize(terms.filter("wide").select("term", (F.col("strength") >= remove_at).alias("remove")), "terms")
    here = near.join(pairs.join(wide, "term", "left_anti"), ["entity", "term"]).groupBy("__p_row", "term").agg((F.max("strength") >= remove_at).alias("remove"))
    # what stands near the entities of one row: bounded by that row
    here = here.groupBy("__p_row").agg(F.collect_list("term").alias("terms"), F.collect_list(F.when(F.col("remove"), F.col("term"))).alias("removed"))
    here = common.materialize(here, "terms-of-rows")
    blanked = F.when(F.size("__p_base") > 0, _blank(F.col("text"), F.col("__p_base"))).otherwise(F.col("text"))

    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(_TERM), F.lit(0))
    wanted = lambda w: common.in_bitmap(w, "__wide")
    rows = scanned.select("__p_row", "__p_base", "text", common.bitmap(wide, "term", "__wide")).withColumn("words", words).filter(F.exists("words", wanted))
    found = rows.select("__p_row", "__wide", blanked.alias("text")).select("__p_row", F.explode(_word_spans(F.col("text"), wanted)).alias("s"))
    found = found.select("__p_row", F.lower("s.word").alias("term"), "s").join(wide, "term").select("__p_row", _term_span(F.col("s"), F.col("remove")).alias("span"))
    found = found.groupBy("__p_row").agg(F.collect_list("span").alias("everywhere"))

    rows = scanned.select("__p_row", "__p_base", "text", common.bitmap(here, "__p_row", "__rows")).filter((F.size("__p_base") > 0) & common.in_bitmap(F.col("__p_row"), "__rows"))
    rows = rows.select("__p_row", blanked.alias("text")).join(here, "__p_row")
    spans = _word_spans(F.col("text"), lambda w: F.array_contains("terms", w))
    local = rows.select("__p_row", F.transform(spans, lambda s: _term_span(s, F.array_contains("removed", F.lower(s["word"])))).alias("here"))

    none = F.array().cast(SPAN)
    both = found.join(local, "__p_row", "full").select("__p_row", F.sort_array(F.concat(F.coalesce("everywhere", none), F.coalesce("here", none))).alias("__p_terms"))
    out = common.materialize(both, "term-spans")
    common.discard(near, pairs, wide, here)
    return out


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, base (base spans), terms (spans the method adds) for every row.

    A null text is empty and has no span. A null id stays null; repeated rows each give a row and count as documents;
    an empty table gives an empty result; other columns are ignored.
    """
    scanned = common.materialize(with_base_spans(common.id_and_text(df, id_col, text_col)), "pii")
    added = term_spans(scanned, **(DEFAULTS | options))
    return scanned.drop("text").join(added, "__p_row", "left").select("doc_id", F.col("__p_base").alias("base"), F.coalesce("__p_terms", F.array().cast(SPAN)).alias("terms"))


def sanitise(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """df with its texts sanitised: base spans become [EMAIL], [IP], [CARD], [PHONE]; disclosing terms are generalised
    or removed. Same columns and rows; texts without a span, null ones too, stay as they are."""
    rows, (place,) = common.placed(df, text_col)
    scanned = common.materialize(with_base_spans(rows, place), "pii-stage")
    text = F.col(place)
    added = term_spans(scanned.select("__p_row", "__p_base", text.alias("text")), **(DEFAULTS | options))
    out = scanned.join(added, "__p_row", "left")
    spans = F.concat("__p_base", F.coalesce("__p_terms", F.array().cast(SPAN)))
    tag = lambda s, pos: F.when(s["start"] < pos, F.lit("")).when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", F.lit("")).otherwise(s["value"])
    clean = F.when(F.size(spans) > 0, _rebuild(text, spans, tag)).otherwise(text)
    return common.named_as(out.withColumn(place, clean), df)


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
