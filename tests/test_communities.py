"""Communities against a plain sequential search for modularity."""

import random
from collections import defaultdict

from tessera.operators.communities import modularity, modularity_communities


def plain_modularity(edges, label):
    total = 2 * sum(w for _, _, w in edges)
    inside, mass = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        mass[label[a]] += w
        mass[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / total - (mass[c] / total) ** 2 for c in mass)


def louvain(edges, seed=0):
    """One node after the other, then contraction; best of what a few orders give."""
    rng = random.Random(seed)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    of, graph = {x: x for x in names}, [(a, b, w) for a, b, w in edges]
    while True:
        near, k, total = defaultdict(lambda: defaultdict(float)), defaultdict(float), 2 * sum(w for *_, w in graph)
        for a, b, w in graph:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        label, mass, moved = {x: x for x in k}, dict(k), True
        order = sorted(k)
        rng.shuffle(order)
        while moved:
            moved = False
            for x in order:
                into = defaultdict(float)
                for y, w in near[x].items():
                    into[label[y]] += w
                mass[label[x]] -= k[x]
                best = max([label[x], *sorted(into)], key=lambda c: into[c] - k[x] * mass[c] / total + (1e-12 if c == label[x] else 0))
                moved |= best != label[x]
                label[x] = best
                mass[best] += k[x]
        if len(set(label.values())) == len(label):
            return of
        of = {x: label[c] for x, c in of.items()}
        merged = defaultdict(float)
        for a, b, w in graph:
            merged[tuple(sorted((label[a], label[b])))] += w
        graph = [(a, b, w) for (a, b), w in merged.items()]


def found(spark, edges, parts=3):
    df = spark.createDataFrame(edges, "source string, target string, weight double").repartition(parts)
    return df, {r["node"]: r["community"] for r in modularity_communities(df).collect()}


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    names = [f"n{g:02d}_{i:02d}" for g in range(groups) for i in range(size)]
    out = []
    for i, a in enumerate(names):
        for b in names[:i]:
            if rng.random() < (inside if a[:3] == b[:3] else outside):
                out.append((a, b, round(rng.uniform(0.2, 1), 3)))
    return out


def test_planted_groups_are_found_whatever_the_order(spark):
    edges = planted(6, 15, 0.7, 0.02, 1)
    df, got = found(spark, edges)
    assert len({c for c in got.values()}) == 6 and all((got[a] == got[b]) == (a[:3] == b[:3]) for a in got for b in got)
    assert all(c == min(x for x in got if got[x] == c) for c in got.values())
    shuffled = [(b, a, w) if i % 2 else (a, b, w) for i, (a, b, w) in enumerate(random.Random(2).sample(edges, len(edges)))]
    assert found(spark, shuffled, 5)[1] == got
    assert abs(modularity(df, modularity_communities(df)) - plain_modularity(edges, got)) < 1e-6


def test_hub_and_odd_edges(spark):
    star = [("hub", f"s{i:03d}", 1.0) for i in range(200)] + [(f"s{i:03d}", f"s{i + 1:03d}", 3.0) for i in range(0, 200, 2)]
    odd = [("a", "a", 2.0), ("a", "b", -1.0), ("b", "c", None), (None, "c", 1.0), ("s000", "s001", 0.5), ("s000", "s001", 0.5)]
    _, got = found(spark, star + odd)
    assert {"a", "b", "c", "hub"} <= set(got) and all(got[f"s{i:03d}"] == got[f"s{i + 1:03d}"] for i in range(0, 200, 2))
    clean = [(a, b, w) for a, b, w in star + odd if a and w and w > 0]
    assert plain_modularity(clean, got) >= plain_modularity(clean, louvain(clean)) - 0.01
    assert found(spark, [("x", "y", 0.0)])[1].keys() == {"x", "y"}
    assert modularity_communities(spark.createDataFrame([], "source string, target string, weight double")).count() == 0


def test_query_is_as_good_as_the_sequential_search(spark):
    from tessera.plans import graph

    sf = "/root/testdata/sf0.01"
    edges = [(str(r["source"]), str(r["target"]), max(r["score"], 0.0)) for r in graph._similar(spark, sf).collect()]
    got = {r["node"]: r["community"] for r in graph.q_modularity_communities(spark, sf).collect()}
    best = max(plain_modularity(edges, louvain(edges, seed)) for seed in range(3))
    assert plain_modularity(edges, got) >= best - 0.01


def test_nothing_is_broadcast_and_frequent_keys_give_the_same(spark, monkeypatch):
    """Facts of hubs and large communities are dealt out in copies by a shuffle; no step broadcasts a table."""
    from tessera.operators import communities as module

    edges = planted(2, 8, 0.8, 0.05, 3) + [("hub", f"n00_{i:02d}", 0.1) for i in range(8)]
    plans, plain, often, lookup = [], module.store, [], module.lookup
    monkeypatch.setattr(module, "store", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, label))
    once = found(spark, edges)[1]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    monkeypatch.setattr(module, "MANY", 3)
    monkeypatch.setattr(module, "SHARES", 20)
    monkeypatch.setattr(module, "lookup", lambda rows, facts, key, keys, spread: often.append(len(keys)) or lookup(rows, facts, key, keys, spread))
    assert found(spark, edges)[1] == once and sum(n > 0 for n in often) > 2
