"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level j holds the j-th chunks of the ids that have one; a bitmap
says which ids continue on the next level, and a rank directory counts set bits before every 512th. Token i is read
with one chunk and one rank per level: no block is decoded.

A segment (magic `DAC1`, number of levels, number of tokens, then for each level its count, chunks, bitmap and
directory) holds whole documents. Segments are rows of Parquet files, so any store that Spark writes can hold them;
each row has its shard, the tokens before it in the shard, and its documents' ids and lengths.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC, BLOCK = b"DAC1", 512
SCHEMA = "shard int, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """A segment's bytes."""
    left = np.asarray(ids, np.uint32)
    levels, total = [], len(left)
    while True:
        on = left >= 256
        last = not on.any()
        bits = b"" if last else np.packbits(on, bitorder="little").tobytes()
        ranks = b""
        if not last:
            marks = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32)
            ranks = np.concatenate(([0], np.cumsum(marks)[:-1])).astype("<u4").tobytes()
        levels.append(struct.pack("<QQ", len(left), len(bits)) + (left & 255).astype(np.uint8).tobytes() + bits + ranks)
        if last:
            return MAGIC + struct.pack("<BQ", len(levels), total) + b"".join(levels)
        left = left[on] >> 8


class DacReader:
    """Random access to a segment's tokens."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        n_levels, self.size = struct.unpack_from("<BQ", data, 4)
        self.levels, at = [], 13
        for _ in range(n_levels):
            count, n_bits = struct.unpack_from("<QQ", data, at)
            at += 16
            chunks, at = np.frombuffer(data, np.uint8, count, at), at + count
            bits, at = data[at : at + n_bits], at + n_bits
            n_ranks = -(-count // BLOCK) if n_bits else 0
            ranks, at = np.frombuffer(data, "<u4", n_ranks, at), at + 4 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * j
            if not bits or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1], "little") & (1 << i - block * BLOCK) - 1
            i = int(ranks[block]) + before.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out = np.zeros(self.size, np.uint32)
        where = None
        for j, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * j)
            if where is None:
                out[:] = part
                where = np.arange(self.size)
            else:
                out[where] |= part
            if bits:
                where = where[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(chunks), bitorder="little").astype(bool)]
        return out


def write_tokens(df: DataFrame, path: str, encode: Callable[[str], np.ndarray], end_id: int = 1, segment_tokens: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every document's ids and end_id in ascending id order (null ids first, ties by text) to `path`.

    Null text is empty: the end id alone. Repeated rows are written each; an empty table writes no segment; other
    columns are ignored. Rows are dealt out by ranges of the id, sorted, and encoded where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            row = ([shard], [before], [held], [doc_ids], [lengths], [dac_encode(np.concatenate(parts))])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                if held and held + len(ids) > segment_tokens:
                    yield segment()
                    before, doc_ids, lengths, parts, held = before + held, [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if held:
            yield segment()

    spark = df.sparkSession
    common.small_batches(spark)
    dealt = common.id_and_text(df, id_col, text_col).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit) of every stored document.

    The driver holds one number per shard, whose count is the write's number of partitions.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = {r["shard"]: r["n"] for r in stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, total = {}, 0
    for shard in sorted(totals):
        offsets[shard] = total
        total += totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = DacReader(row["payload"]).all().astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - np.array(row["doc_tokens"])
                base = offsets[row["shard"]] + row["local_start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int]:
    """The tokens at global positions: finds their segments by metadata, then reads single chunks."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    out, base = {}, 0
    for shard, n in totals:
        for p in (p for p in positions if base <= p < base + n):
            row = stored.filter((F.col("shard") == shard) & (F.col("local_start") <= p - base) & (F.col("local_start") + F.col("n_tokens") > p - base)).select("local_start", "payload").first()
            out[p] = DacReader(bytes(row["payload"]))[p - base - row["local_start"]]
        base += n
    return out
