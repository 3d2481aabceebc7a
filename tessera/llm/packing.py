"""Harmonic packing of documents into fixed-capacity sequences, independently in every partition.

A piece whose length is at most capacity / k, and hardly less, belongs to reciprocal class k; a bin of class k takes
exactly k pieces, so a worker never looks for room. Lengths between classes are cut: the head takes the longest length of
the next class whose k longest pieces fill a bin, and the tail is classed again. What a partition's unfinished bins hold at its end is laid end to end into full
sequences, and the last remainder is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_lengths(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document with n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest * k >= capacity * (1 - slack):
            out.append((rest, k))
            break
        k += 1
        while capacity // k * k < capacity * (1 - slack):
            k += 1
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


class HarmonicPacker:
    """Bins of one partition. Holds at most k - 1 pieces of each of the about 2 * sqrt(capacity) classes."""

    def __init__(self, capacity: int, slack: float, first_sequence: int):
        self.capacity, self.slack, self.next = capacity, slack, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, total, ids in pieces:
            yield doc_id, start, len(ids), total, self.next, at, ids.tobytes()
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for length, k in cut_lengths(len(ids), self.capacity, self.slack):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, len(ids), ids[start : start + length].copy()))
            start += length
            if len(bin_) == k:
                del self.open[k]
                yield from self._close(bin_)

    def finish(self) -> Iterator[tuple]:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open.clear()
        left = sum(len(ids) for *_, ids in rest)
        room, bin_ = self._next_size(left), []
        for doc_id, start, total, ids in rest:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                bin_.append((doc_id, start + at, total, part))
                at, room, left = at + len(part), room - len(part), left - len(part)
                if not room:
                    yield from self._close(bin_)
                    room, bin_ = self._next_size(left), []

    def _next_size(self, left: int) -> int:
        """A full sequence, or the largest power of two that the remainder fills."""
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)


def pack(df: DataFrame, encode: Callable[[str], np.ndarray], end_id: int = 1, capacity: int = 2048, slack: float = 1 / 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    `encode` gives a text's ids; end_id is appended to every document. A null text is empty and so one piece with the
    end id alone; a null id stays null; repeated rows are packed as separate documents; an empty table gives an empty
    result; other columns are ignored. Every id lies in exactly one piece; a class's bins waste at most `slack`.
    Needs no shuffle: each partition packs its own documents, and sequence ids carry the partition's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = HarmonicPacker(capacity, slack, TaskContext.get().partitionId() << 36)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += packer.add(doc_id, np.append(encode(text or ""), np.uint32(end_id)).astype("<u4"))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
        rows += packer.finish()
        for at in range(0, len(rows), 2000):
            yield _batch(rows[at : at + 2000])

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)
