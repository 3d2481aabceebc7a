"""Token alignment against spans compared one by one, documents counted by hand."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.alignment import align, aligned, alignments, frequent_from, overlaps, owners, pair_counts

SF = "/root/testdata/sf0.01"
SIDES = queries.aligned_sides()


class Plain:
    """Both libraries as they are, and every pair of spans looked at."""

    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        self.a_bytes, self.b_bytes = SIDES()[0].tokens, SIDES()[1].tokens

    @staticmethod
    def spans(parts):
        at, out = 0, []
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    def __call__(self, text):
        if not text:
            return 0, 0, 0, "", []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts_a, parts_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            return 0, 0, 0, "", []
        sa, sb = self.spans(parts_a), self.spans(parts_b)
        groups, low = [], 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, spans) if low <= s < end) for ids, spans in ((a, sa), (b, sb))))
            low = end
        links, first = [], 0
        for i, (s, e) in zip(a, sa):
            while sb[first][1] <= s:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < e:
                links.append(i << 32 | b[j])
                j += 1
        return len(a), len(b), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def brute():
    return Plain()


def expected(rows, brute):
    """doc_id and all columns of the query for rows (doc_id, text)."""
    done = [(i, *brute(text)) for i, text in rows]
    held = Counter(pair for *_, links in done for pair in set(links))
    most = defaultdict(int)
    for pair, n in held.items():
        most[pair >> 32] = max(most[pair >> 32], n)
    return [(i, a, b, g, len(x), sum(held[p] == most[p >> 32] for p in x), sum(held[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if g else "") for i, a, b, g, s, x in done]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s> </s> <unk>"), (5, "a▁b"), (6, "naïve 日本 \U0001F600"), (7, "the cat"), (7, "the cat"), (None, "the cat"), (8, "word " * 3000), (9, "\x00\n\t"), (10, "x" * 5000)]


def key(rows):
    return sorted(rows, key=repr)


def test_overlaps_by_owners():
    a, b, cut = overlaps(owners(np.array([2, 1, 3])), owners(np.array([1, 2, 3])))
    assert list(zip(a, b)) == [(0, 0), (0, 1), (1, 1), (2, 2)] and list(cut) == [True, False, False, True]


def test_align_equals_brute_force(brute):
    rng = random.Random(4)
    alphabet = ["a", "the ", "ing", "\n", " ", "é", "日", "<|endoftext|>", "<s>", "▁", "1234", "\x00", "!", "\U0001F600", "qz"]
    texts = [t for _, t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]
    for text in texts:
        got, want = align(text, *SIDES()), brute(text)
        assert got[:4] == want[:4] and sorted(got[4].tolist()) == sorted(want[4])


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_odd_rows(spark, brute, frequent):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in ODD], "doc_id long, text string, chunk long, pair string").repartition(3)
    out = aligned(df, SIDES, frequent=frequent)
    assert key(tuple(r[c] for c in COLUMNS) for r in out.collect()) == key(expected(ODD, brute))
    assert {r["groups"] for r in out.filter("doc_id = 7").collect()} == {brute("the cat")[3]}
    assert aligned(df.limit(0), SIDES).count() == 0


def test_frequent_pairs_are_bounded(spark):
    df = spark.createDataFrame([(i, "common words " + "rare" * i) for i in range(40)], "doc_id long, text string")
    counts = pair_counts(alignments(df, SIDES).filter("pairs is not null"))
    for most in (0, 1, 2, 5, 100):
        assert counts.filter(counts["n"] >= frequent_from(counts, most)).count() <= most


def test_whole_table(spark, brute):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, SF).collect()]
    assert key(got) == key(expected(rows, brute))
