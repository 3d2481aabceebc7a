"""Column functions over text: identifiers, cleaning, tokens, sentences, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are page furniture.
NOISE_LINES = (r"(?i)^\s*Trang\s+\d+(\s*/\s*\d+)?\s*$", r"(?i)^\s*Page\s+\d+(\s+of\s+\d+)?\s*$", r"^\s*\d+\s*$")
#: Word characters for tokens, written so that other engines read the class alike.
WORD = r"[\p{L}\p{N}_]"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, underscore, 16 hex digits over the parts; null, empty, zero and false parts are alike."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    texts = [F.when(t.isin("0", "false"), F.lit("")).otherwise(t) for t in texts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 16))


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks become one, none stay beside a line break, and at most one empty line stays."""
    text = F.regexp_replace(text, r"[\t\x{00A0} ]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def unify_breaks(text: Column) -> Column:
    """Without byte-order marks and zero-width spaces, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x{FEFF}\x{200B}]", ""), r"\r\n?", "\n")


def clean_lines(text: Column) -> Column:
    """Text without page furniture; empty lines stay."""
    noise = "|".join(f"(?:{p})" for p in NOISE_LINES)
    lines = F.transform(F.split(unify_breaks(text), "\n"), collapse_spaces)
    return collapse_spaces(F.array_join(F.filter(lines, lambda x: ~x.rlike(noise)), "\n"))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased words of at least `least` characters, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{%d,}" % least), F.lit(0))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def sentences(text: Column) -> Column:
    """Cut after sentence punctuation and at line breaks; trimmed, without empty ones."""
    parts = F.split(text, r"(?<=[.;:!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 0)


def first_hit(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first name of the table with a phrase in the lower-cased text."""
    low, out = F.lower(text), None
    for name, phrases in table:
        hit = None
        for p in phrases:
            one = low.contains(p)
            hit = one if hit is None else hit | one
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the lower-cased text contains."""
    low, total = F.lower(text), F.lit(0)
    for p in phrases:
        total = total + low.contains(p).cast("int")
    return total


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """ISO date of three numbers as text, null where the calendar has no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def strict_date(value: Column) -> Column:
    """A date only from YYYY-MM-DD that exists."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def compact_upper(value: Column) -> Column:
    """Upper case, Đ as D, letters and digits only."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(value, F.lit(""))), "Đ", "D"), "[^0-9A-Z]", "")


def unique_value(values: Column) -> Column:
    """The only distinct value of an array, else null."""
    distinct = F.array_distinct(F.array_compact(values))
    return F.when(F.size(distinct) == 1, distinct[0])


def missing(fields: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(problem, F.lit(name)) for name, problem in fields.items()]))
