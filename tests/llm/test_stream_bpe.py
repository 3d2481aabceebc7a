"""The streaming transducer against the library; its lookahead against all texts over small merge lists."""

import hashlib
import itertools
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.stream_bpe import Decoder, Encoder, Transducer, merges, sufficient_lookahead, transduce, windows

SF = "/root/testdata/sf0.01"
WORDS = P.path("word_bpe_49k.json")
HARD = ["", " ", "\n\n  \n", "a", "don't I'LL we've", "é日本ß 12½", "<|endoftext|> x <|startoftext|>y<|endoftext|><|endoftext", "x" * 3000, " " * 500, "a\x00\x01\x1cb", "it  's  a   test \n ", "İstanbul ΣΑΣ é", "word " * 3000, "é" * 300, "각" * 50, "!'s!!'re''ll" * 60, "日本語テキスト" * 200, "à̖" * 100, "՘࢏ x", "'" * 700]
ALPHABET = ["a", "b", "'", "s", "re", "ll", "!", "1", " ", "\n", "é", "Σ", "日", "́", "İ", "<|endoftext|>", "<|", "the", "tion", "\U0001F600", "กำ", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def bpe(text, ranks):
    """Plain merging: the lowest rank, the leftmost of equal ones, again and again."""
    parts = list(text)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_lookahead_settles_every_first_token():
    rng, longest = random.Random(5), 0
    for _ in range(150):
        tokens, pairs = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 7)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) <= 5:
                tokens.append(u + v)
                pairs.append((u, v))
        ranks, ahead = {p: i for i, p in enumerate(pairs)}, sufficient_lookahead(pairs, len)
        longest = max(longest, ahead)
        for _ in range(60):
            text = "".join(rng.choices("abc", k=ahead + 6))
            whole = bpe(text, ranks)
            first = whole[0]
            begin = text[: len(first) + ahead]
            for tail in ("", *map("".join, itertools.product("abc", repeat=3))):
                assert bpe(begin + tail, ranks)[0] == first
    assert longest > 5


def test_lookahead_of_the_merge_list_is_known():
    assert merges(WORDS).lookahead == 145


@pytest.mark.parametrize("window", [5, 13, 64, 1 << 16])
def test_ids_equal_the_library(library, window):
    rng, encoder = random.Random(window), Encoder(WORDS, window)
    texts = HARD + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 120))) for _ in range(600)] + ["".join(rng.choices("abcdet'", k=2000)) for _ in range(10)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        blocks = list(encoder.blocks(text))
        assert [i for block in blocks for i in block] == ids
        decoder = Decoder(encoder.table, True)
        assert "".join([*map(decoder.feed, blocks), decoder.end()]) == library.decode(ids, skip_special_tokens=False)


def test_what_is_held_stays_small(library):
    rng, run, out = random.Random(6), Transducer(merges(WORDS)), []
    word = bytes(rng.choices(b"etaoinshr", k=50000))
    for at in range(0, len(word), 777):
        out += run.push(word[at : at + 777])
        assert len(run.held) <= run.limit
    assert out + run.close() == library.encode(word.decode(), add_special_tokens=False).ids


def test_text_is_decoded_as_it_comes():
    encoder = Encoder(WORDS)
    for text, want in (("Naïve 日本, \U0001F600!", "naïve 日本 , \U0001F600! "), ("", ""), ("a<|endoftext|>B", "a <|endoftext|>b ")):
        decoder = Decoder(encoder.table)
        assert "".join(decoder.feed([i]) for block in encoder.blocks(text) for i in block) + decoder.end() == want


def test_windows_give_the_text_back():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 80)))
        assert "".join(x for x, _ in windows(text, 9)) == text


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "b c"), (3, "two Words"), (3, "two Words"), (4, "x" * 200_000), (5, "日本" * 70_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    want = [(i, *(lambda e: (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)))(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert sorted(map(tuple, transduce(df, WORDS).collect()), key=repr) == sorted(want, key=repr)
    assert transduce(df.limit(0), WORDS).count() == 0


def test_whole_table(spark, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op13_stream_bpe(spark, SF).collect()} == want
