"""The queries over whole tables of sf0.01 against the libraries, document by document; edges of their operators."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import packing, pii, queries, token_counts, token_store, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_equals_the_library(spark, docs):
    from tessera.llm.vocab import rank_encoding

    exact = rank_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert isinstance(exact, tiktoken.Encoding)
    rows = queries.op2_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = exact.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r["doc_id"]].encode()))


def test_packing_holds_every_id_once(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, filled = {}, {}
    for r in queries.op3_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    used = padded = 0
    for parts in filled.values():
        n = 0
        for offset, length in sorted(parts):
            assert offset == n and length > 0
            n += length
        assert n <= 2048
        used, padded = used + n, padded + (n if n & (n - 1) == 0 else 2048)
    assert padded < 1.02 * used


def test_token_counts_equal_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = queries.op8_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_token_store_equals_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, at = {r["doc_id"]: r for r in queries.op9_token_store(spark, SF).collect()}, 0
    assert set(got) == set(docs)
    for doc_id in sorted(docs):
        ids = [*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 1]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_toxicity_over_the_whole_table(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert set(rows) == set(docs) and all(0 <= r["p_low_quality"] <= 1 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in rows.values())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = sum(rows[r["doc_id"]]["toxic"] == (r["toxic"] == 1) for r in labels if r["doc_id"] in rows)
    assert right > 0.97 * len(labels)


CLASH = "doc_id long, text string, ids string, start int, sequence_id int, n_tokens int, toxic string, toxicity string, __p string"
ROWS = [(1, None), (2, ""), (None, "a b"), (3, "one two three"), (3, "one two three"), (4, "word " * 30_000)]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1, 1, 1, "x", "x", "x") for i, t in ROWS], CLASH)


def test_packing_edges(spark):
    rows = packing.pack(frame(spark), queries.byte_encoder(), 1, 2048).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r["length"] for r in rows) == want
    twice = [r for r in rows if r["doc_id"] == 3]
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None} and sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 1] == [(1, 1)]


def test_token_store_edges(spark, tmp_path):
    token_store.write_tokens(frame(spark), str(tmp_path / "t"), queries.word_encoder(), 1)
    rows = sorted(token_store.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4] and [r["n_tokens"] for r in rows][1:3] == [1, 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_token_count_edges(spark):
    rows = token_counts.token_counts(frame(spark), P.path("byte_bpe_50k.json")).collect()
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert got[1:3] == [(1, 0, 0, False), (2, 0, 0, False)] and got[3] == got[4] and got[5][1:] == (150_000, got[5][2], True)


def test_toxicity_training_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, 1), (3, 1, None), (9, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(frame(spark), labels)
    rows = toxicity.toxicity(frame(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["p_toxic"] <= 1 for r in rows)
    many = spark.createDataFrame([(7, f"clown {i}") for i in range(50)] + [(i, "fine day") for i in range(20, 60)], "doc_id long, text string")
    model = toxicity.train(many, spark.createDataFrame([(7, 1, 1)] + [(i, 0, 1) for i in range(20, 60)], "doc_id long, toxic int, quality int"))
    assert toxicity.toxicity(many, model).count() == 90


def test_personal_data_edges(spark):
    long = "quiet words " * 20_000 + "ann@corp.ee"
    df = spark.createDataFrame([(1, long), (1, long), (None, "ann@corp.ee"), (2, None)], "doc_id long, text string")
    rows = pii.personal_data(df).collect()
    assert sorted(len(r["base"]) for r in rows) == [0, 1, 1, 1]
    out = {r["text"] for r in pii.sanitise(df).collect()}
    assert None in out and all("ann@" not in t for t in out if t)
