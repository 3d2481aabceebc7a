"""SimHash fingerprints and their near copies by anchor-point covering.

Fingerprints are cut into blocks. A pair that differs in at most `threshold` bits differs in at most one bit of some union
of blocks, if blocks and unions are chosen for that. In each union the anchors are a covering code of radius 1: a perfect
Hamming code on the first 15 (7, 3) bits and every value of the rest. Each fingerprint has its nearest anchor as home and
visits all anchors within covering radius plus one, so that a pair meets at the home of either; fingerprints are compared
there over all 64 bits. Larger unions have more anchors and fewer fingerprints at each, but send each fingerprint to more
of them: the number of fingerprints decides. Every anchor reports a spanning forest of the links it finds, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components
from .jaccard import similar_links, sketch

SEED = 42
#: Groups up to this size are compared by one vectorised step; larger ones are searched outward from each home.
SMALL = 48


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 majority bits over the hashes of the text's word shingles, repeats included; 0 without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


#: What it costs to send a fingerprint to one more anchor, in comparisons.
SEND = 200


def _worst(threshold: int, blocks: int, joined: int, most: int | None = None) -> int:
    """The most differing bits that every union of `joined` of the blocks can have, over all ways to place them."""
    best = 0

    def place(left: int, most: int, held: list[int]) -> None:
        nonlocal best
        if len(held) == blocks:
            best = max(best, sum(held[-joined:]) if not left else 0)  # held falls: the last ones are the least
            return
        for n in range(min(left, most), -1, -1):
            place(left - n, n, [*held, n])

    place(threshold, threshold, [])
    return best


class AnchorCode:
    """The covering codes of all unions of `joined` of `blocks` blocks, as vectorised look-ups."""

    def __init__(self, threshold: int, bits: int = 64, blocks: int | None = None, joined: int = 1):
        blocks = blocks or threshold // 2 + 1
        assert _worst(threshold, blocks, joined) <= 1
        base, more = divmod(bits, blocks)
        widths = [base + (i >= blocks - more) for i in range(blocks)]
        starts = [0, *accumulate(widths)][:-1]
        self.unions = [[(starts[i], widths[i]) for i in which] for which in combinations(range(blocks), joined)]
        self.checks = min(4, (min(widths) * joined + 1).bit_length() - 1)
        self.n = (1 << self.checks) - 1  # length of the Hamming code
        values = np.arange(1 << self.n, dtype=np.uint32)
        self.syndrome = np.zeros(1 << self.n, np.uint8)
        for i in range(self.n):
            self.syndrome ^= (values >> i & 1).astype(np.uint8) * np.uint8(i + 1)
        single = [0] + [1 << i for i in range(self.n)]
        self.nearest = np.array(single, np.uint64)  # by syndrome: the change that leads to the nearest code word
        pairs: list[list[int]] = [[] for _ in range(self.n + 1)]
        for i, j in combinations(range(self.n), 2):
            pairs[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
        self.pairs = np.array(pairs[1:], np.uint64)  # by syndrome - 1: the changes of two bits that lead to a code word

    def cost(self, n: int) -> float:
        """Of each of n fingerprints: anchors it is sent to, and fingerprints that chance brings there to its homes."""
        sizes = [sum(w for _, w in union) for union in self.unions]
        sent = [1 + (size - self.n) + self.n // 2 for size in sizes]
        return SEND * sum(sent) + sum(k * n / 2.0 ** (size - self.checks) for k, size in zip(sent, sizes))

    def homes_and_visits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor key (union's number above 48 bits of anchor), fingerprint, whether it is the home."""
        keys, who, home = [], [], []
        low_mask = np.uint64((1 << self.n) - 1)
        for number, union in enumerate(self.unions):
            value, width = np.zeros_like(prints), 0
            for start, size in union:
                value |= (prints >> np.uint64(start) & np.uint64((1 << size) - 1)) << np.uint64(width)
                width += size
            syndrome = self.syndrome[value & low_mask]
            own = value ^ self.nearest[syndrome]
            made = [(own, prints, True)]
            made += [(own ^ np.uint64(1 << bit), prints, False) for bit in range(self.n, width)]
            off = syndrome > 0
            changed = value[off][:, None] ^ self.pairs[syndrome[off] - 1]
            made.append((changed.ravel(), np.repeat(prints[off], changed.shape[1]), False))
            for anchor, fp, is_home in made:
                keys.append(anchor | np.uint64(number << 48))
                who.append(fp)
                home.append(np.full(len(fp), is_home))
        return np.concatenate(keys), np.concatenate(who), np.concatenate(home)


def code_for(n: int, threshold: int) -> AnchorCode:
    """The cheapest code for n fingerprints; all of them find the same links."""
    shapes = [(m, u) for m in range(1, threshold + 4) for u in range(1, m + 1) if 12 <= 64 // m * u <= 40 and _worst(threshold, m, u) <= 1]
    shapes = shapes or [(threshold // 2 + 1, 1)]
    return min((AnchorCode(threshold, blocks=m, joined=u) for m, u in shapes), key=lambda code: code.cost(n))


def _small_links(starts, sizes, prints, home, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small groups at once: every home against its group."""
    group = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(home)
    n = sizes[group[at]]
    left = np.repeat(at, n)
    ends = np.cumsum(n)
    right = np.arange(len(left)) - np.repeat(ends - n, n) + np.repeat(starts[group[at]], n)
    near = (np.bitwise_count(prints[left] ^ prints[right]) <= threshold) & (prints[left] != prints[right])
    return prints[left[near]], prints[right[near]]


def _large_links(prints, home, threshold) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large group: each found fingerprint is compared with those not found yet, and once."""
    rest = np.unique(prints)
    roots, found = [], []
    for start in prints[home]:
        queue = [start]
        while queue:
            near = np.bitwise_count(rest ^ queue.pop()) <= threshold
            if near.any():
                more, rest = rest[near], rest[~near]
                more = more[more != start]
                roots.append(np.full(len(more), start))
                found.append(more)
                queue.extend(more)
    return (np.concatenate(roots), np.concatenate(found)) if roots else (prints[:0], prints[:0])


def _links(keys: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; every group is complete."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    useful = (sizes > 1) & (np.add.reduceat(home, starts, dtype=np.int64) > 0)
    out = []
    small = useful & (sizes <= SMALL)
    if small.any():
        rows = np.repeat(small, sizes)
        n = sizes[small]
        out.append(_small_links(np.cumsum(n) - n, n, prints[rows], home[rows], threshold))
    for start, size in zip(starts[useful & ~small], sizes[useful & ~small]):
        out.append(_large_links(prints[start : start + size], home[start : start + size], threshold))
    if not out:
        return prints[:0], prints[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct, stored) at up to `threshold` differing bits."""
    code = code_for(prints.count(), threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys, who, home = code.homes_and_visits(batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who.view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            keys, who, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
            if held and keys[0] == keys[-1] == held[-1][0][-1]:
                held.append((keys, who, home))
                continue
            parts = [*held, (keys[:cut], who[:cut], home[:cut])]
            held = [(keys[cut:], who[cut:], home[cut:])]
            yield from done(parts)
        yield from done(held)

    def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, who, home = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
        if len(keys):
            a, b = _links(keys, who.view(np.uint64), home.astype(bool), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    spread = prints.select("fp").mapInArrow(deal, "key long, fp long, home boolean")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def component_roots(first: DataFrame, threshold: int) -> DataFrame:
    """fp, root for every distinct fingerprint that links to another one; root stands for its component."""
    return _roots(fingerprint_links(first, threshold))


def _roots(links: DataFrame) -> DataFrame:
    roots = connected_components(links, "a", "b")
    return roots.select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, threshold: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links) for every row.

    A null or empty text has fingerprint zero and links like any other. A null id stays null and never names a
    component unless all its members' ids are null. Repeated rows each give a row; an empty table gives an empty
    result; other columns are ignored. Only distinct fingerprints are compared, so exact copies cost nothing.
    """
    own = common.materialize(fingerprints(df, shingle, id_col, text_col), "prints")
    first = common.materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    linked = component_roots(first, threshold).join(first, "fp").select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    classes = common.materialize(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "classes")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(df: DataFrame, threshold: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", alike: float | None = None, alike_shingle: int = 5) -> DataFrame:
    """One row of each component of df: the one with the smallest id (null ids last), of repeated rows any one. Same
    columns. A component's first row comes from an aggregate that combines before the shuffle, however large it is.
    With `alike`, texts whose `alike_shingle`-word shingles have at least that Jaccard similarity are linked, too."""
    rows_of, (id_place, text_place) = common.placed(df, id_col, text_col)
    at = df.columns.index(text_col)
    more = [("__s_fp", T.LongType()), ("__s_row", T.LongType()), ("__s_set", T.LongType()), ("__s_n", T.LongType()), ("__s_keys", T.ArrayType(T.LongType())), ("__s_bits", T.ArrayType(T.LongType()))]
    schema = T.StructType([*rows_of.schema.fields, *[T.StructField(n, t) for n, t in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(at).to_pylist()
            prints = np.array([fingerprint(x, shingle) for x in texts], np.uint64)
            rows = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            sets, sizes, keys, bits = zip(*[sketch(x, alike_shingle) if alike else (0, 0, [], []) for x in texts]) if texts else ((), (), (), ())
            made = [pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(list(x), pa.list_(pa.int64())) for x in (keys, bits)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64)), rows, *made], schema.names)

    common.small_batches(df.sparkSession)
    marked = common.materialize(rows_of.mapInArrow(run, schema), "dedup-stage")
    mine = marked.select(F.col(id_place).alias("id"), F.col("__s_fp").alias("fp"), F.col("__s_row").alias("row"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    first = common.materialize(mine.groupBy("fp").agg(best), "distinct-prints")
    links = fingerprint_links(first, threshold)
    if alike:
        links = common.materialize(links, "near-links")
        own = F.min(F.struct(F.col("__s_row").alias("row"), F.col("__s_n").alias("n"), F.col("__s_keys").alias("keys"), F.col("__s_bits").alias("bits"))).alias("s")
        sketches = marked.groupBy("__s_fp", "__s_set").agg(own).select("s.row", F.col("__s_fp").alias("grp"), "s.n", "s.keys", "s.bits")
        links = similar_links(sketches, marked.select(F.col("__s_row").alias("row"), F.col(text_place).alias("text")), links, alike, alike_shingle)
    roots = _roots(links)
    winners = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__s_row"))
    return common.named_as(marked.join(winners, "__s_row", "left_semi"), df)
