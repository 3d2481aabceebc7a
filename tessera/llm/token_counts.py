"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .vocab import library_tokenizer, safe_chunks


def _balanced(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with about `budget` bytes each; a larger item stands alone."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def count_texts(texts: list[str], vocab_path: str, batch_bytes: int, chunk_chars: int) -> list[int]:
    """Tokens of each text: long texts are cut at safe boundaries, pieces are encoded in batches of equal bytes."""
    tokenizer = library_tokenizer(vocab_path)
    pieces: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for piece in safe_chunks(text, chunk_chars):
            pieces.append(piece)
            owner.append(i)
    counts = [0] * len(texts)
    for begin, end in _balanced([len(p.encode()) for p in pieces], batch_bytes):
        for i, encoding in zip(owner[begin:end], tokenizer.encode_batch_fast(pieces[begin:end], add_special_tokens=False)):
            counts[i] += len(encoding)
    return counts


def token_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 20, chunk_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; an empty table
    gives an empty result; other columns are ignored. Texts never leave the worker: only three numbers return per row.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = count_texts(texts, vocab_path, batch_bytes, chunk_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
