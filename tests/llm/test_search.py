"""Exact search, SimHash and the language model against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import hmm, queries
from tessera.llm.components import connected_components
from tessera.llm.exact_search import best_of_block, choose_pivots, exact_top_k
from tessera.llm.simhash import AnchorCode, _large_links, code_for, fingerprint, fingerprint_links, keep_one_of_each, near_duplicates

SF = "/root/testdata/sf0.01"


def top_k(rows, k):
    out = {}
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (q, a) in enumerate(good):
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
            out[n] = [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(x for rows in out.values() for x in rows)


def test_exact_search_with_edges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(260)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(400, None), (500, [None] * 8), (600, [math.nan] * 8), (700, [math.inf] * 8), (None, rows[0][1]), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (900, []), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in exact_top_k(df, k=5, block_rows=64, block_queries=2, n_pivots=6).collect())
    assert got == top_k(rows, 5)
    assert exact_top_k(df.limit(0)).count() == 0


def test_exact_search_equals_oracle(spark, duck):
    got = sorted(tuple(r) for r in queries.op6_exact_search(spark, SF).collect())
    assert got == sorted(duck.sql(queries.OP6_SQL).fetchall())


def test_search_sql_takes_repeated_ids_as_rows(spark, tmp_path):
    import duckdb

    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (5, [1.0, 1.0]), (5, [3.0, 1.0]), (100, [0.5, 0.5]), (7, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op6_exact_search(spark, str(tmp_path)).collect())
    assert got == sorted(duck.sql(queries.OP6_SQL).fetchall()) and len(got) == 10


def test_pivots_eliminate():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (20, 8))
    rows = (centres[rng.integers(0, 20, 2000)] + rng.integers(-30, 30, (2000, 8))).astype(np.int64)
    rows = (rows * 1000 / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    pairs, scored = best_of_block(rows[:5], np.arange(5), rows, np.arange(2000), choose_pivots(rows.astype(float), 32), 10)
    assert len(pairs) == 50 and scored < 5 * 2000 / 2


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", None, "One two", "a B c d e f g a b c d", " x\ty \n z w v "):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text) == want


def components(values, threshold):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= threshold:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in vs}


def near_values(rng, n_groups, per_group):
    out = {0}
    for _ in range(n_groups):
        base = rng.getrandbits(64)
        for _ in range(per_group):
            v = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            out.add(v)
    return out


def test_every_link_meets_at_an_anchor():
    rng = random.Random(9)
    codes = [(t, AnchorCode(t)) for t in (2, 3, 4, 5, 6)] + [(t, code_for(n, t)) for t in (1, 3, 4, 5) for n in (1000, 10**8, 10**11)]
    assert len({len(code.unions) for t, code in codes if t == 4}) > 1
    for threshold, code in codes:
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, threshold)):
                b ^= 1 << bit
            keys, who, home = code.homes_and_visits(np.array([a, b], np.uint64))
            homes = {int(k) for k, w, h in zip(keys, who, home) if h and int(w) == a}
            assert homes & {int(k) for k, w in zip(keys, who) if int(w) == b}


def test_anchors_grow_with_the_fingerprints():
    alone = [code_for(n, 4).cost(n) for n in (10**5, 10**9, 10**10)]
    assert alone[2] < 30 * alone[0] and AnchorCode(4).cost(10**10) > 100 * alone[0]


def test_links_connect_what_brute_force_connects(spark):
    for threshold, groups, size in ((4, 60, 12), (3, 20, 20), (4, 1, 400)):
        values = near_values(random.Random(threshold + size), groups, size)
        want = components(values, threshold)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
        links = fingerprint_links(df, threshold)
        for a, b in links.collect():
            assert want[a % (1 << 64)] == want[b % (1 << 64)]
        got = {r["node"] % (1 << 64): r["root"] for r in connected_components(links, "a", "b").collect()}
        groups_got, groups_want = {}, {}
        for v in values:
            groups_got.setdefault(got.get(v, ("alone", v)), set()).add(v)
            groups_want.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


def test_large_group_gives_a_forest():
    values = np.array(sorted(near_values(random.Random(1), 1, 3000)), np.uint64)
    a, b = _large_links(values, np.ones(len(values), bool), 4)
    assert len(a) < len(values)


def test_chain_of_links_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_near_duplicates_at_sf(spark):
    docs = [(r["doc_id"], fingerprint(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    roots = components({f for _, f in docs}, 4)
    first = {}
    for i, f in docs:
        first[roots[f]] = min(i, first.get(roots[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", first[roots[f]]) for i, f in docs}


def test_near_duplicates_edges(spark):
    rows = [(3, "same text of some words"), (1, "same text of some words"), (None, "same text of some words"), (5, None), (4, ""), (None, "unique words stand here alone"), (9, "w " * 40000), (9, "w " * 40000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {1, 4, 9, None}
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 9]
    assert keep_one_of_each(df.limit(0)).count() == near_duplicates(df.limit(0)).count() == 0


def test_forward_and_counts_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm.Hmm(share(3), share(3, 3), share(3, 5).T)
    texts = [np.array(t) for t in ([0, 4, 2, 2], [1], [3, 3, 0])]
    start, moves, emission = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text, got in zip(texts, hmm.log_likelihoods(model, texts)):
        total, parts = 0.0, []
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            total += p
            parts.append((path, p))
        assert abs(math.log(total) - got) < 1e-9
        for path, p in parts:
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emission[text[t], s] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    for want, got in zip((start, moves, emission), hmm.expected_counts(model, texts)):
        assert np.allclose(want, got)


def test_long_texts_are_counted_whole(monkeypatch):
    """In pieces or at once, alone or with others: the same counts."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm.Hmm(share(3), share(3, 3), share(3, 5).T)
    texts = [rng.integers(0, 5, n).astype("<u2") for n in (1, 2, 7, 50, 51, 100, 101, 333)]
    want = [sum(x) for x in zip(*[hmm.expected_counts(model, [t]) for t in texts])]
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array([t.tobytes() for t in texts], pa.binary())], ["row", "classes"])
    for size, buffer in ((50, 10), (50, 10**6), (400, 200), (10**6, 10**6)):
        monkeypatch.setattr(hmm, "BATCH_TOKENS", size)
        monkeypatch.setattr(hmm, "BUFFER_TOKENS", buffer)
        assert all(np.allclose(a, b) for a, b in zip(want, hmm.counts_of(model, iter([rows]))))
    assert abs(want[2].sum() - sum(map(len, texts))) < 1e-6


def test_latent_states_help_on_held_out_texts(spark, monkeypatch):
    held = lambda: sum(r["score"] for r in queries.op10_lm_scoring(spark, SF).filter("held_out").collect())
    several = held()
    monkeypatch.setattr(hmm, "first_model", lambda total, states=1, plain=hmm.first_model: plain(total, 1))
    monkeypatch.setattr(hmm, "STATES", 1)
    assert several > 0.95 * held()


def test_long_texts_do_not_underflow():
    model = hmm.first_model(np.ones(hmm.CLASSES))
    text = np.arange(50_000) % hmm.CLASSES
    whole = hmm.log_likelihoods(model, [text, text[:3]])
    now, total = model.start * model.emit[text[0]], 0.0
    for c in text[1:]:
        scale = now.sum()
        total, now = total + math.log(scale), (now / scale) @ model.move * model.emit[c]
    assert abs(whole[0] - total - math.log(now.sum())) < 1e-6 * abs(whole[0])


def test_scores_at_sf(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*hmm.words_of(t), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op10_lm_scoring(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        tokens, r = [*hmm.words_of(t), None], got[i]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_scores_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b", 3), (3, "a b " * 20000, 4), (3, "a b", 5)], "doc_id long, text string, row int")
    got = hmm.score_texts(df).collect()
    assert len(got) == 5 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    only_held = spark.createDataFrame([(None, "x y")], "doc_id long, text string")
    r = hmm.score_texts(only_held).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)
    assert hmm.score_texts(df.limit(0)).count() == 0


def test_every_round_takes_every_text(spark, monkeypatch):
    """Scores don't depend on the order or the partitions of the rows, and all training texts count in each round."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30))) for i in range(60)]
    scored = []
    for parts in (1, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        scored.append({r["doc_id"]: r["score"] for r in hmm.score_texts(df).collect()})
    assert all(abs(scored[0][i] - scored[1][i]) < 1e-6 for i, _ in rows)
    seen, plain = [], hmm._reestimate
    monkeypatch.setattr(hmm, "_reestimate", lambda m, sums, total: seen.append(sum(sum(r["n"]) for r in sums if r["kind"] == 0)) or plain(m, sums, total))
    hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(seen) > 1 and all(abs(n - sum(not hmm.held_out(i) for i, _ in rows)) < 1e-6 for n in seen)


def test_components_over_many_files(spark, monkeypatch):
    """Several tasks, rounds and dealt-out hubs give what one task gives."""
    from tessera.llm import components as module

    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + rng.randrange(400), 2000 + rng.randrange(400)) for _ in range(250)]
    rng.shuffle(links)
    df = spark.createDataFrame(links + [(5, 5), (None, 1)], "a long, b long")
    once = sorted(map(tuple, module.connected_components(df, "a", "b").collect()))
    assert {r for n, r in once if n < 2000} == {0, 1000} and len({n for n, _ in once}) == len(once)
    monkeypatch.setattr(module, "LINKS_PER_FILE", 100)
    monkeypatch.setattr(module, "HUB", 20)
    assert sorted(map(tuple, module.connected_components(df.repartition(3), "a", "b").collect())) == once


def test_training_goes_on_while_held_out_texts_gain(spark, monkeypatch):
    """No gain is too small: training ends with ROUNDS, where held-out texts lose, or where nothing moves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rounds, plain = [], hmm._reestimate
    monkeypatch.setattr(hmm, "_reestimate", lambda *x: rounds.append(1) or plain(*x))
    monkeypatch.setattr(hmm, "ROUNDS", 7)
    held = lambda: sum(r["score"] for r in hmm.score_texts(docs).filter("held_out").collect())
    seven = held()
    assert len(rounds) == 7
    monkeypatch.setattr(hmm, "ROUNDS", 4)
    assert seven > held()


def test_blocks_hold_every_text_once(spark):
    """Texts are laid out once for all rounds, held-out ones apart; each token is in one block."""
    texts = [(i, i % 4 == 0, np.random.default_rng(i).integers(0, 50, 1 + i * 7 % 90).astype("<u2")) for i in range(200)]
    coded = spark.createDataFrame([(i, h, bytearray(t.tobytes())) for i, h, t in texts], "row long, held_out boolean, classes binary").repartition(3)
    got = {True: [], False: []}
    for r in hmm.laid_out(coded).collect():
        tokens, running = np.frombuffer(r["tokens"], "<u2"), np.frombuffer(r["running"], "<i4")
        begins = np.cumsum(running) - running
        got[r["held_out"]] += [tuple(tokens[begins[running > i] + i].tolist()) for i in range(running[0])]
    assert all(sorted(got[h]) == sorted(tuple(t.tolist()) for _, x, t in texts if x == h) for h in got)


def test_shares_depend_on_words_alone(spark, monkeypatch):
    """A round after the first counts one share of the texts anew. Every training text is in one share, whatever the order and
    number of tasks; a text that occurs often doesn't fall to one task."""
    monkeypatch.setattr(hmm, "BUFFER_TOKENS", 200)
    texts = [(i, i % 5 == 0, bytes(np.random.default_rng(i if i < 150 else 1).integers(0, 50, 20).astype("<u2"))) for i in range(400)]
    seen = []
    for parts in (1, 4):
        coded = spark.createDataFrame([(i, h, bytearray(t)) for i, h, t in texts], "row long, held_out boolean, classes binary").repartition(parts)
        blocks, shares = hmm.laid_out(coded), {}
        for r in blocks.collect():
            tokens, running = np.frombuffer(r["tokens"], "<u2"), np.frombuffer(r["running"], "<i4")
            assert r["held_out"] == (r["share"] == hmm.HELD_OUT)
            begins = np.cumsum(running) - running
            for i in range(running[0]):
                shares.setdefault(r["share"], []).append(tokens[begins[running > i] + i].tobytes())
        seen.append({s: sorted(x) for s, x in shares.items()})
        often = max((s for s in shares if s != hmm.HELD_OUT), key=lambda s: len(shares[s]))
        assert len(blocks.filter(f"share = {often}").inputFiles()) > 2
    assert seen[0] == seen[1] and set(seen[0]) == {hmm.HELD_OUT, *range(hmm.SHARES)}
    assert sorted(x for s, y in seen[0].items() if s != hmm.HELD_OUT for x in y) == sorted(t for _, h, t in texts if not h)


def test_counts_stay_right_where_short_numbers_do_not_reach():
    """States that a text favours by turns in the extreme: products of a few steps leave the range of short numbers."""
    emit, move = np.array([[1 - 1e-30, 1e-30], [1e-30, 1 - 1e-30]]), np.array([[1 - 1e-12, 1e-12], [1e-12, 1 - 1e-12]])
    model, text = hmm.Hmm(np.array([0.5, 0.5]), move, emit), np.array([0, 1, 0, 0, 1, 1, 0] * 9)
    with np.errstate(all="ignore"):
        short = hmm._block_counts(model, text, np.ones(len(text), int), None, None, hmm._Room(), np.float32)
    got = hmm.expected_counts(model, [text])
    want = hmm._block_counts(model, text, np.ones(len(text), int), None, None, hmm._Room(), np.float64)
    assert not np.isfinite(short[2]).all() or not np.allclose(short[1], want[1])
    assert all(np.allclose(a, b) for a, b in zip(got, (want[0], want[1], want[2].T))) and abs(got[1].sum() - len(text) + 1) < 1e-6
