"""Disclosing terms against a plain Python computation of the same definition."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import xxhash

from tessera.llm import pii

TERM = re.compile(r"[^\W_]{2,}")
EMAIL = re.compile(r"[a-z]+@[a-z]+\.[a-z]+")


def log_tail(k, drawn, marked, total):
    a, q = k / drawn, marked / total
    return -drawn * (a * math.log(a / q) + ((1 - a) * math.log((1 - a) / (1 - q)) if a < 1 else 0)) if a > q else 0.0


def least_hashes(terms):
    seeds = [xxhash.xxh64_intdigest(struct.pack("<i", i), 42) for i in range(pii.HASHES)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return tuple(min((signed(xxhash.xxh64_intdigest(t.encode(), s)) for t in terms), default=0) for s in seeds)


def different(contexts):
    """How many contexts there are, each counted as far as it differs from the others."""
    alike = sum(sum(c * c for c in Counter(h[i] for h in contexts).values()) for i in range(pii.HASHES)) / pii.HASHES
    return len(contexts) ** 2 / alike


def brute(texts, window=120, significance=0.05, generalise_at=0.7, remove_at=0.95):
    """Per text: {(start, end): removed} of the terms, over e-mail entities."""
    n, near, n_t, masked = len(texts), defaultdict(dict), defaultdict(int), []
    for i, text in enumerate(texts):
        text = text or ""
        for term in {w.lower() for w in TERM.findall(text)}:
            n_t[term] += 1
        blank = EMAIL.sub(lambda m: " " * len(m[0]), text)
        masked.append(blank)
        for m in EMAIL.finditer(text):
            around = set()
            for w in TERM.finditer(blank):
                if m.start() - window <= w.start() and w.end() <= m.end() + window:
                    around.add(w[0].lower())
            for term in [*around, None]:
                near[i, m[0]].setdefault(term, set()).update(around)
    docs, contexts, pair_docs, pair_contexts = defaultdict(set), defaultdict(list), defaultdict(set), defaultdict(list)
    for (i, e), terms in near.items():
        docs[e].add(i)
        for term, context in terms.items():
            if term is None:
                contexts[e].append(least_hashes(context))
            else:
                pair_docs[e, term].add(i)
                pair_contexts[e, term].append(least_hashes(context))
    least = math.log(significance) - math.log(max(len(pair_docs), 1))
    strong = {}
    for (e, t), where in pair_docs.items():
        n_e, k = len(docs[e]), min(len(where), len(docs[e]), n_t[t])
        ic = math.log(n / n_e)
        strength = math.log(k * n / (n_e * n_t[t])) / ic if ic > 0 else 0.0
        local = min(log_tail(k, n_e, n_t[t], n), log_tail(k, n_t[t], n_e, n)) <= least
        k_et, k_e = different(pair_contexts[e, t]), different(contexts[e])
        wide = log_tail(k_et, max(k_e, k_et), n_t[t], n) <= least
        if strength >= generalise_at and (local or wide):
            strong[e, t] = (strength, wide)
    everywhere = {t for (_, t), (_, wide) in strong.items() if wide}
    out = []
    for i, blank in enumerate(masked):
        here = defaultdict(float)
        for (e, t), (strength, _) in strong.items():
            if t in everywhere or i in pair_docs[e, t]:
                here[t] = max(here[t], strength)
        out.append({(w.start(), w.end()): here[w[0].lower()] >= remove_at for w in TERM.finditer(blank) if w[0].lower() in here})
    return out


def test_terms_by_brute_force(spark):
    rng = random.Random(8)
    common_words = ["river", "stone", "paper", "Light", "garden", "music", "winter", "table", *[f"word{i}" for i in range(300)]]
    texts = [None, "", "x@y.zz", "alone ann@corp.ee ￿ Peak"]
    for i in range(400):
        words = [rng.choice(common_words) for _ in range(rng.randint(3, 60))] + [f"rare{rng.randint(0, 150)}"]
        if i % 10 == 0:  # one person in many contexts, with a town that gives them away
            words[rng.randint(0, len(words)) : 0] = ["Quixton", "ann@corp.ee"]
        elif i % 10 == 1:
            words.append(rng.choice(["bob@site.org", "eve@site.org"]))
        elif i % 40 == 2:
            words.append("quixton")
        rng.shuffle(words)
        texts.append(" ".join(words))
    copy = "Passage of copies with Zebulon and carl@copy.ee and more " + "music " * 40 + "zebulon far away"
    texts += [copy.replace(*rng.choice([("Passage", "Passages"), ("more", "less"), ("of", "off"), ("", "")])) for _ in range(30)]
    texts += [f"some other text mentions Zebulon {i}" for i in range(3)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    got = {r["doc_id"]: {(s["start"], s["end"]): s["value"] == "remove" for s in r["terms"]} for r in pii.personal_data(df).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want)) and sum(map(len, want)) > 60
    # copies let a term go in them, near and far, not elsewhere
    assert all(len(want[-4 - k]) > len(want[-1 - k % 3]) == 0 for k in range(30))


def test_positions_in_a_very_long_text(spark):
    words = [("hit" if i % 7 == 0 else f"word{i}") for i in range(40_000)]
    text = "é " + "  ".join(words)
    df = spark.createDataFrame([(text,), ("",), ("hit",), ("no",)], "text string")
    spans = pii._word_spans(df["text"], lambda w: w == "hit")
    rows = df.select("text", spans.alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["end"]) for s in r["s"] or []] == [m.span() for m in re.finditer(r"\bhit\b", r["text"])]
