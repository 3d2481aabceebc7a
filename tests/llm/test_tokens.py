"""Byte-level BPE, fast ids, packing, counts and the token store against the libraries and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fast_ids, queries
from tessera.llm.packing import HarmonicPacker, cut_lengths, pack
from tessera.llm.prefix_bpe import EncodedText, encode_documents, worker_bpe
from tessera.llm.token_counts import count_texts, token_counts
from tessera.llm.token_store import DacReader, dac_encode, read_documents, token_at, write_tokens
from tessera.llm.vocab import library_tokenizer, rank_encoding, safe_chunks

MULTI, BYTES, RANKS, WORDS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
HARD = ["", None, " ", "\n\n  \n", "a", "don't I'LL we've", "é日本ß 12½", "<|endoftext|> x <|startoftext|>", "x" * 3000, " " * 500, "a\x00\x01\x1cb", "it  's  a   test \n ", "İstanbul ΣΑΣ é", "word " * 5000]


def library(path, text):
    return library_tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_equal_the_library(text):
    text = text or ""
    assert list(fast_ids.byte_level_ids(text, BYTES, RANKS, P.PATTERN)) == library(BYTES, text)
    assert list(fast_ids.word_ids(text, WORDS)) == library(WORDS, text)
    assert worker_bpe(MULTI, P.PATTERN).encode(text) == rank_encoding(MULTI, P.PATTERN).encode_ordinary(text)


def test_known_characters_one_by_one():
    for c in range(0x2100):
        text = f"a{chr(c)}b {chr(c)}C 1{chr(c)}{chr(c)} {chr(c)}"
        if fast_ids.plain(text):
            assert list(fast_ids.word_ids(text, WORDS)) == library(WORDS, text), hex(c)
            assert list(fast_ids.byte_level_ids(text, BYTES, RANKS, P.PATTERN)) == library(BYTES, text), hex(c)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    bpe = worker_bpe(MULTI, P.PATTERN)
    ids = bpe.encode(text)
    assert ids == rank_encoding(MULTI, P.PATTERN).encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_appends_and_edits_are_exact_and_local():
    bpe, exact, rng = worker_bpe(MULTI, P.PATTERN), rank_encoding(MULTI, P.PATTERN), random.Random(4)
    for _ in range(300):
        text = EncodedText(bpe, "".join(rng.choice("ab etao 12.\n'sl  é") for _ in range(60)))
        for _ in range(4):
            at = rng.randint(0, len(text.text))
            text.replace(at, min(len(text.text), at + rng.randint(0, 5)), "".join(rng.choice("ab eto 1.\n's  ") for _ in range(rng.randint(0, 6))))
            assert text.ids() == exact.encode_ordinary(text.text)
    long = EncodedText(bpe, "some words here " * 500)
    before = long.recomputed
    long.replace(4000, 4001, "zz")
    assert long.recomputed - before < 100 and long.ids() == exact.encode_ordinary(long.text)


def test_every_prefix_has_its_encoding():
    bpe, exact = worker_bpe(MULTI, "(?s).+"), rank_encoding(MULTI, "(?s).+")
    data = b"unbelievably"
    table = bpe.extend(data, [])
    for n in range(1, len(data) + 1):
        assert bpe.walk(table, n) == exact.encode_ordinary(data[:n].decode())


def frame(spark, texts=HARD):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")


def test_operators_handle_edges(spark):
    df = frame(spark)
    empty = df.limit(0)
    encode = queries.byte_encoder()
    assert token_counts(empty, BYTES).count() == encode_documents(empty, MULTI, P.PATTERN).count() == pack(empty, encode).count() == 0
    got = {r["doc_id"]: r for r in token_counts(df.unionByName(df), BYTES).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(library(BYTES, t)) for i, t in enumerate(HARD)}
    assert all(r["n_bytes"] == len((HARD[i] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 512) for i, r in got.items())
    for r in encode_documents(df, MULTI, P.PATTERN).collect():
        assert bytes(r["decoded"]) == (HARD[r["doc_id"]] or "").encode()
    null_id = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert token_counts(null_id, BYTES).first()["doc_id"] is None


def test_safe_chunks_change_no_token():
    rng = random.Random(2)
    text = "".join(rng.choice("ab  \n\t'sé1.") for _ in range(4000))
    assert "".join(safe_chunks(text, 50)) == text and len(safe_chunks(text, 50)) > 10
    assert count_texts([text], BYTES, 200, 50) == [len(library(BYTES, text))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60), st.sampled_from([64, 100, 2048]))
def test_packing_loses_nothing(sizes, capacity):
    packer, out = HarmonicPacker(capacity, 1 / 64, 0), []
    docs = [np.arange(n, dtype="<u4") for n in sizes if n]
    for i, d in enumerate(docs):
        out += packer.add(i, d)
    out += packer.finish()
    filled = {}
    for doc, start, length, total, seq, offset, ids in out:
        assert total == len(docs[doc]) and ids == docs[doc][start : start + length].tobytes()
        filled.setdefault(seq, []).append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at >= capacity * (1 - 1 / 64) - 1 or at & (at - 1) == 0)
    for i, d in enumerate(docs):
        assert sorted((s, n) for doc, s, n, *_ in out if doc == i) == [(s, n) for s, n in _spans(out, i)]
        assert sum(n for doc, _, n, *_ in out if doc == i) == len(d)


def _spans(out, i):
    at, spans = 0, sorted((s, n) for doc, s, n, *_ in out if doc == i)
    for s, n in spans:
        assert s == at
        at += n
    return spans


def test_classes_hold_equal_numbers():
    for n in range(1, 5000):
        assert sum(x for x, _ in cut_lengths(n, 2048, 1 / 64)) == n
        assert all(x * k <= 2048 for x, k in cut_lengths(n, 2048, 1 / 64))


@pytest.mark.parametrize("capacity", [64, 100, 2048])
def test_no_class_wastes_more_than_the_slack(capacity):
    for n in range(1, 2 * capacity + 1):
        pieces = cut_lengths(n, capacity, 1 / 64)
        assert sum(x for x, _ in pieces) == n
        assert all(capacity * (1 - 1 / 64) <= x * k <= capacity for x, k in pieces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_direct_codes_round_trip(values):
    ids = np.array(values, np.uint32)
    reader = DacReader(dac_encode(ids))
    assert list(reader.all()) == values
    assert [reader[i] for i in range(0, len(values), 7)] == values[::7]


def test_store_round_trip(spark, tmp_path):
    rows = [(5, "b b"), (None, "n"), (2, None), (9, "word " * 300), (2, "a"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    write_tokens(df, path, queries.word_encoder(), 1, segment_tokens=50)
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r["start"])
    order = [(None, "n"), (2, None), (2, "a"), (5, "b b"), (7, ""), (9, "word " * 300)]
    stream = []
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = library(WORDS, text) + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, len(stream), len(ids))
        assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        stream += ids
    assert token_at(spark, path, [0, 3, len(stream) - 2]) == {i: stream[i] for i in (0, 3, len(stream) - 2)}
    write_tokens(df.limit(0), str(tmp_path / "none"), queries.word_encoder())
    assert read_documents(spark, str(tmp_path / "none")).count() == 0
