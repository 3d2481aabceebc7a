"""Links between texts whose word shingles are alike, confirmed by the exact Jaccard similarity of both texts.

Candidates share one of 32 bands of four min-hashes each; a pair at similarity 0.8 shares none with a chance of 5e-8.
Only bands of two texts or more go on. Their members are first confirmed against the band's first text, so that a large
group of copies becomes one component by as many comparisons as it has members. Then, between any two components that
still meet in a band, the closest pair is confirmed, and at last every pair that is left. Before a text moves, parities of
the shingles rule out pairs that cannot be as alike as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BANDS, ROWS = 32, 4
_MULTIPLY = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate([len(w) + 1 for w in words]))
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[min(size, len(words)) - 1 :])], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One key a band, none without a shingle."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 512):
        mixed = own[at : at + 512] ^ _MIX[:, None]
        mixed *= _MULTIPLY[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def parity(own: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the shingles that fall on it: two texts differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((own >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) % 2 == 1).view(np.int64)


def sketch(text: str | None, size: int = 5) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A hash of the text's shingles, their number, its band keys, its parities."""
    own = shingles(text, size)
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]), len(own), bands(own), parity(own)


def _confirmed(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """a, b: the pairs (row_a, row_b, a, b) whose texts (row, text) are as alike as that."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, np.ndarray] = {}
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for text in (left, right):
                    if text not in known:
                        known[text] = shingles(text, size)
                keep.append(similarity(known[left], known[right]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = common.materialize(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct()
    some = texts.select("row", "text", common.bitmap(asked, "row", "__bits")).filter(common.in_bitmap(F.col("row"), "__bits"))
    named = lambda side: some.select(F.col("row").alias(f"row_{side}"), F.col("text").alias(f"text_{side}"))
    both = pairs.join(named("a"), "row_a").join(named("b"), "row_b")
    out = common.materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "alike")
    common.discard(pairs)
    return out


def _components(sketches: DataFrame, links: DataFrame) -> DataFrame:
    """row, grp, n, bits, c for every text: c is the component of its group."""
    roots = connected_components(links, "a", "b").select(F.col("node").alias("grp"), "root")
    out = sketches.select("row", "grp", "n", "bits").join(roots, "grp", "left").withColumn("c", F.coalesce("root", "grp")).drop("root")
    return common.materialize(out, "components")


def _sides(about: DataFrame, side: str) -> DataFrame:
    return about.select(*[F.col(x).alias(f"{x}_{side}") for x in ("row", "grp", "n", "bits", "c")])


def _possible(least: float) -> Column:
    """Whether a pair of texts in different components can be as alike as that, by their sizes and parities."""
    sizes = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    return (F.col("c_a") != F.col("c_b")) & sizes & (_differ() <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - least) / (1 + least)) + 1e-6)


def _differ() -> Column:
    return sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(4)), F.lit(0))


def similar_links(sketches: DataFrame, texts: DataFrame, links: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """links (a, b between groups) and those between groups of texts at `least` similarity, enough to connect them all.

    sketches: row, grp, n (shingles), keys (bands), bits (parities), one for each distinct text of a group; texts: row,
    text.
    """
    sketches = common.materialize(sketches, "sketches")
    keyed = sketches.select("row", F.posexplode("keys").alias("band", "key"))
    often = keyed.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("k")).filter("k > 1").select("key", "first")
    member = common.materialize(keyed.join(often, "key"), "members")
    pair = ["row_a", "row_b", F.col("grp_a").alias("a"), F.col("grp_b").alias("b")]

    def more(links: DataFrame, pairs: DataFrame, about: DataFrame) -> DataFrame:
        found = _confirmed(pairs, texts, least, size)
        out = common.materialize(links.unionByName(found), "near-links", files=None)
        common.discard(found, about)
        return out

    def meeting(about: DataFrame) -> DataFrame:
        """Pairs of texts in different components that share a band and can be as alike as asked, each at the first band
        that it shares."""
        own = member.select("key", "band", "row").join(about.select("row", "c"), "row")
        mixed = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
        open_ = common.materialize(own.join(mixed, "key").select("key", "band", "row"), "open-members")
        asked = open_.select("row").distinct()
        keys = sketches.select("row", "keys", common.bitmap(asked, "row", "__bits")).filter(common.in_bitmap(F.col("row"), "__bits")).drop("__bits")
        sides = common.materialize(open_.join(about, "row").join(keys, "row"), "open-sides")
        named = lambda side: [F.col(x).alias(f"{x}_{side}") for x in ("row", "grp", "n", "bits", "c", "keys")]
        met = sides.select("key", "band", *named("a")).join(sides.select("key", *named("b")), "key")
        earlier = F.exists(F.zip_with(F.slice("keys_a", F.lit(1), F.col("band")), F.slice("keys_b", F.lit(1), F.col("band")), lambda x, y: x == y), lambda x: x)
        return met.filter((F.col("row_a") < F.col("row_b")) & _possible(least) & ~earlier)

    about = _components(sketches, links)
    star = member.filter("row <> first").select(F.col("row").alias("row_a"), F.col("first").alias("row_b")).distinct()
    star = star.join(_sides(about, "a"), "row_a").join(_sides(about, "b"), "row_b").filter(_possible(least))
    links = more(links, star.select(*pair), about)
    about = _components(sketches, links)
    between = meeting(about).groupBy(F.least("c_a", "c_b").alias("low"), F.greatest("c_a", "c_b").alias("high")).agg(F.min(F.struct(_differ().alias("differ"), *pair)).alias("best"))
    closest = common.materialize(between.select("best.row_a", "best.row_b", "best.a", "best.b"), "closest")
    if closest.isEmpty():  # no pair is left at all
        return links
    links = more(links, closest, about)
    about = _components(sketches, links)
    return more(links, meeting(about).select(*pair).distinct(), about)
