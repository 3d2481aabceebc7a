"""Alignment of two tokenizers over the same bytes by arrays of owners.

Repeating each token's index over its bytes gives every byte its owner in A and in B. Where the pair of owners changes, a
new overlap begins; where both owners change at once, both tokenizers cut. How many documents hold a pair of ids is counted
over the whole corpus: documents are worked off in chunks of bounded size, each with a dictionary of its distinct pairs, so
that what is shuffled are dictionaries and not links.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fast_ids import byte_symbols, plain
from .vocab import library_tokenizer, rank_encoding, safe_chunks

#: What is broadcast: the pairs of ids held by most documents, so many at most.
FREQUENT = 1 << 16
CHUNK_CHARS = 1 << 16
#: Characters of a chunk of documents, which a longer text exceeds alone: bounds what a worker holds besides its batch.
CHUNK = 2 << 20
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs binary, held binary"


class Side:
    """One tokenizer: ids of a text and the bytes of every id."""

    def __init__(self, encode: Callable[[str], np.ndarray], tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        numbers = [str(i) for i in range(len(tokens))]
        #: Decimal ids with what follows them, within a group and at the end of their side of it.
        self.inner, self.last = (np.array([x + mark for x in numbers], object) for mark in (",", "|"))
        self.closing = np.array([x + ";" for x in numbers], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def byte_side(vocab_path: str, ranks_path: str | None, pattern: str) -> Side:
    """A byte-level vocabulary file over a space and the text; strings of special tokens are plain text."""
    symbols = byte_symbols()
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["id"]: x["content"] for x in spec["added_tokens"]}
    names = {i: x for x, i in spec["model"]["vocab"].items()} | special
    tokens = [names[i].encode() if i in special else bytes(symbols[c] for c in names[i]) for i in range(max(names) + 1)]

    def encode(text: str) -> np.ndarray:
        text = " " + text
        if ranks_path and plain(text):
            parts = [rank_encoding(ranks_path, pattern).encode_to_numpy(x, disallowed_special=()) for x in safe_chunks(text, CHUNK_CHARS)]
            return np.concatenate(parts).astype(np.int64)
        tokenizer = library_tokenizer(vocab_path)
        tokenizer.encode_special_tokens = True
        try:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        finally:
            tokenizer.encode_special_tokens = False

    return Side(encode, tokens)


@functools.lru_cache(maxsize=2)
def piece_side(model_path: str) -> Side:
    """A sentencepiece model over the text, to which it adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    tokens = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return Side(lambda text: np.array(model.encode(text, num_threads=1), np.int64), tokens)


def owners(lengths: np.ndarray) -> np.ndarray:
    """Each byte's token."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the owners of every byte on both sides: the A and the B token of each overlap in order, and which overlaps begin
    where both sides cut."""
    moves_a, moves_b = a[1:] != a[:-1], b[1:] != b[:-1]
    starts = np.concatenate(([0], np.flatnonzero(moves_a | moves_b) + 1))
    cut = np.concatenate(([True], (moves_a & moves_b)[starts[1:] - 1]))
    return a[starts], b[starts], cut


def written(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, a: Side, b: Side) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`, from the group of every token: A's tokens of a group, then B's."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
    out[np.arange(len(ids_a)) + np.searchsorted(of_b, of_a)] = np.where(last_a, a.last[ids_a], a.inner[ids_a])
    out[np.arange(len(ids_b)) + np.searchsorted(of_a, of_b, side="right")] = np.where(last_b, b.closing[ids_b], b.inner[ids_b])
    return "".join(out.tolist())[:-1]


def align(text: str | None, a: Side, b: Side) -> tuple[int, int, int, str, np.ndarray]:
    """Numbers of A tokens, B tokens and groups, the groups, and the linked pairs as A id << 32 | B id."""
    nothing = 0, 0, 0, "", np.empty(0, np.int64)
    if not text:
        return nothing
    ids_a, ids_b, whole = a.encode(text), b.encode(text), (" " + text).encode()
    if a.joined(ids_a) != whole or b.joined(ids_b) != whole:
        return nothing
    over_a, over_b, cut = overlaps(owners(a.lengths[ids_a]), owners(b.lengths[ids_b]))
    group = np.cumsum(cut) - 1
    # a token lies in one group: that of its first overlap
    of_a, of_b = (group[np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))] for x in (over_a, over_b))
    return len(ids_a), len(ids_b), int(group[-1]) + 1, written(ids_a, ids_b, of_a, of_b, a, b), ids_a[over_a] << 32 | ids_b[over_b]


def _place(size: int) -> str:
    """The type of a place in a dictionary of that size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def alignments(df: DataFrame, sides: Callable[[], tuple[Side, Side]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document and, last in each chunk, one row with the chunk's dictionary.

    Of a document: doc_id, n_a, n_b, n_groups, n_links, groups, and links, places in the dictionary (unsigned, of 16 bits in
    one of up to 65536 pairs, else 32). Of a dictionary: pairs (A id << 32 | B id, 64-bit, ascending) and held, by how many documents of the chunk (unsigned 32-bit).
    """
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides()
        chunk = TaskContext.get().partitionId() << 32
        for ids, texts in chunks(batches):
            done = [align(text, a, b) for text in texts]
            counts = np.array([len(x[4]) for x in done], np.int64)
            pairs, places = np.unique(np.concatenate([x[4] for x in done]), return_inverse=True)
            held = np.unique(np.repeat(np.arange(len(done)), counts) * max(1, len(pairs)) + places) % max(1, len(pairs))
            ends = np.cumsum(counts)
            parts = [x.tobytes() for x in np.split(places.astype(_place(len(pairs))), ends[:-1])]
            columns = [[*ids, None], *[[*[x[i] for x in done], None] for i in range(3)], [*counts.tolist(), None], [*[x[3] for x in done], None], [*parts, None]]
            columns += [[None] * len(done) + [x] for x in (pairs.astype("<i8").tobytes(), np.bincount(held, minlength=len(pairs)).astype("<u4").tobytes())]
            kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([[chunk] * (len(done) + 1), *columns], kinds)], names)
            chunk += 1

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(run, ALIGNED)


def _entries(dictionaries: DataFrame) -> DataFrame:
    """chunk, place, pair, n: the dictionaries' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<u4").astype(np.int64)
                for at in range(0, len(pairs), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    place = np.arange(at, at + len(pairs[some]), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), chunk)), pa.array(place), pa.array(pairs[some]), pa.array(held[some])], ["chunk", "place", "pair", "n"])

    return dictionaries.select("chunk", "pairs", "held").mapInArrow(run, "chunk long, place int, pair long, n long")


def pair_counts(dictionaries: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n: by how many documents of all each pair is held, is_best: whether that is the highest of
    its A id. One row an A id, at most its vocabulary, is broadcast."""
    counts = common.materialize(_entries(dictionaries).groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    out = counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    return out


def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least power of two from which on no more than `most` pairs have such a count."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("k")).collect()
    known, total, size = {r["size"]: r["k"] for r in sizes}, 0, 63
    while size >= 0 and total + known.get(size, 0) <= most:
        total += known.get(size, 0)
        size -= 1
    return 1 << (size + 1)


def aligned(df: DataFrame, sides: Callable[[], tuple[Side, Side]], id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if kept, groups for every row.

    Texts that are null or empty, or whose tokens of one side don't give back the space and the text, have no tokens: zeros
    and an empty string. A null id stays null; repeated rows are documents of their own, for counts, too; an empty table
    gives an empty result; other columns are ignored. Counts of the most frequent pairs go to every task, as many as
    `frequent` at most; all others come by a join with the chunks' dictionaries.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.col("groups"))
    rows = alignments(df, sides, id_col, text_col).withColumn("groups_sha256", digest)
    # a chunk's rows lie in one bucket: only what is looked up for its dictionary is shuffled, not its links
    rows = common.materialize(rows if keep_groups else rows.drop("groups"), "alignments", buckets="chunk")
    dictionaries = rows.filter("pairs is not null")
    counts = common.materialize(pair_counts(dictionaries), "linked-pairs")
    often = counts.filter(F.col("n") >= frequent_from(counts, frequent)).select("pair", "n", "is_best")
    entries = _entries(dictionaries).select("chunk", "place", "pair")
    known = entries.join(F.broadcast(often), "pair", "left")
    rest = known.filter("n is null").select("chunk", "place", "pair").join(counts, "pair")
    looked_up = known.filter("n is not null").unionByName(rest).select("chunk", "place", "n", "is_best")
    told = [x for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups") if x in rows.columns]
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{x} {kinds[x]}" for x in told] + ["n_best long", "count_sum long"])

    def join(documents: pa.Table, entries: pa.Table) -> pa.Table:
        size = entries.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = entries["place"].to_numpy()
        n[place], best[place] = entries["n"].to_numpy(), entries["is_best"].to_numpy().astype(np.int64)
        links = [np.frombuffer(x, _place(size)) for x in documents["links"].to_pylist()]
        out = documents.select(told)
        out = out.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64()))
        return out.append_column("count_sum", pa.array([int(n[x].sum()) for x in links], pa.int64()))

    documents = rows.filter("pairs is null").select("chunk", "links", *told)
    return documents.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(join, schema)
