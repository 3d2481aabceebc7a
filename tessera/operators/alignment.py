"""Text comparison that built-in functions don't have: composition, similarity ratio, white-space alignment, reading order."""

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def compose(text: str | Column) -> Column:
    """Canonical composition; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(_column(text))


def similarity(left: str | Column, right: str | Column) -> Column:
    """Ratio of matching blocks of two texts."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 6) for x, y in zip(a, b)])

    return F.pandas_udf(run, "double")(_column(left), _column(right))


def shifts(inner: str, outer: str) -> list[tuple[int, int]] | None:
    """Pieces (position in inner, shift to outer) of an alignment in which only white space may differ, else None.

    An exact copy must be the only one; otherwise both texts are walked without their white space.
    """
    at = outer.find(inner) if inner else -1
    if at >= 0:
        return [(0, at)] if outer.find(inner, at + 1) < 0 else None
    bare = [(i, c) for i, c in enumerate(inner) if not c.isspace()]
    other = [(i, c) for i, c in enumerate(outer) if not c.isspace()]
    needle, hay = "".join(c for _, c in bare), "".join(c for _, c in other)
    start = hay.find(needle) if needle else -1
    if start < 0 or hay.find(needle, start + 1) >= 0:
        return None
    out: list[tuple[int, int]] = []
    for (i, _), (j, _) in zip(bare, other[start:]):
        if not out or out[-1][1] != j - i:
            out.append((i, j - i))
    return out


def align(inner: str | Column, outer: str | Column) -> Column:
    """Piecewise shifts from the inner to the outer text, null where they don't align."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [shifts(x or "", y or "") for x, y in zip(a, b)]
        return pd.Series([None if x is None else [{"at": at, "shift": by} for at, by in x] for x in found])

    return F.pandas_udf(run, "array<struct<at:int,shift:int>>")(_column(inner), _column(outer))


def shifted(position: Column, pieces: Column) -> Column:
    """A position of the inner text in the outer one."""
    return position + F.element_at(F.filter(pieces, lambda p: p["at"] <= position), -1)["shift"]


def conflicts(items: DataFrame, identity: str, position: str, text: str, version: str, below: float = 0.85) -> DataFrame:
    """left, right, ratio: pairs of different versions of one identity whose texts differ more than the bound allows.

    Pairs form within one identity only, whose versions in force at one date are few.
    """
    a = items.select(F.col(identity).alias("identity"), F.col(position).alias("a_pos"), F.col(text).alias("a_text"), F.col(version).alias("left"))
    b = items.select(F.col(identity).alias("identity"), F.col(position).alias("b_pos"), F.col(text).alias("b_text"), F.col(version).alias("right"))
    pairs = a.join(b, "identity").filter((F.col("a_pos") < F.col("b_pos")) & (F.col("left") != F.col("right")))
    return pairs.withColumn("ratio", similarity("a_text", "b_text")).filter(F.col("ratio") < below).select("identity", "left", "right", "ratio")


def reading_lines(cells: Column) -> Column:
    """Lines of text from cells (text, top, bottom, left): a cell joins the row before it if their middles are within
    .4 of the smaller height; rows from top to bottom, cells from left to right."""
    order = F.sort_array(F.transform(cells, lambda c: F.struct(((c["top"] + c["bottom"]) / 2).alias("mid"), c["left"].alias("left"), (c["bottom"] - c["top"]).alias("height"), c["text"].alias("text"))))
    kind = "array<struct<mid:double,height:double,cells:array<struct<left:double,text:string>>>>"

    def add(rows: Column, c: Column) -> Column:
        last = F.element_at(rows, -1)
        cell = F.struct(c["left"].alias("left"), c["text"].alias("text"))
        joins = (F.size(rows) > 0) & (F.abs(c["mid"] - F.get(rows, F.size(rows) - 1)["mid"]) <= 0.4 * F.least(c["height"], F.get(rows, F.size(rows) - 1)["height"]))
        grown = F.struct(last["mid"].alias("mid"), last["height"].alias("height"), F.concat(last["cells"], F.array(cell)).alias("cells"))
        fresh = F.struct(c["mid"].alias("mid"), c["height"].alias("height"), F.array(cell).alias("cells"))
        return F.when(joins, F.concat(F.slice(rows, 1, F.greatest(F.lit(0), F.size(rows) - 1)), F.array(grown))).otherwise(F.concat(rows, F.array(fresh))).cast(kind)

    rows = F.aggregate(order, F.array().cast(kind), add)
    return F.transform(rows, lambda r: F.array_join(F.transform(F.sort_array(r["cells"]), lambda c: c["text"]), " "))


def needs_ocr(chars: Column, coverage: Column, bad: Column, blank: Column, rotated: Column, threshold: int = 100, always: bool = False) -> Column:
    """Whether a page's native text must be replaced by recognised text."""
    few = (chars < 40) | ((chars < threshold) & (coverage > 0.25)) | ((coverage > 0.6) & (chars < 2000)) | (bad > 0.02)
    return ~blank & (rotated | F.lit(always) | few)
