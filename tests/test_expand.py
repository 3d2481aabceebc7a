"""Best-first expansion against a plain search, with hubs, ties and several first nodes a seed."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph as G


def plain(seeds, edges, score, rounds, k):
    near = {}
    for a, b, t in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, []).append(round(score[t], 6))
    out = set()
    for seed in {s for s, _ in seeds}:
        front = [n for s, n in seeds if s == seed]
        seen = set(front)
        for turn in range(1, rounds + 1):
            best = {}
            for x in front:
                for y, s in near.get(x, {}).items():
                    if y not in seen:
                        best[y] = min(best.get(y, (1, "")), (-max(s), x))
            front = sorted(best, key=lambda y: (best[y][0], y))[:k]
            out |= {(seed, y, turn, best[y][1], -best[y][0]) for y in front}
            seen |= set(front)
    return out


def test_rows_that_cannot_enter_are_left_out_early(spark):
    rng, score = random.Random(3), {"a": 0.9, "b": 0.5, "c": 0.1}
    edges = [(f"h{i % 3}", f"n{i:03}", rng.choice("abc")) for i in range(150)]
    edges += [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}", rng.choice("abc")) for _ in range(250)]
    table = spark.createDataFrame(edges, "source string, target string, type string")
    weight = F.coalesce(*[F.when(F.col("type") == t, F.lit(w)) for t, w in score.items()])
    for starts in (1, 9):  # more first nodes than one take more of a hub's best edges
        seeds = [(f"s{i}", f"n{(i * 7 + j) % 150:03}") for i in range(20) for j in range(starts)] + [("hub", "h0")]
        got = G.expand(spark.createDataFrame(seeds, "seed string, node string"), table, weight, 3, 4).filter("round > 0")
        assert {tuple(r) for r in got.select("seed", "node", "round", "parent", "score").collect()} == plain(seeds, edges, score, 3, 4)


def test_a_hub_spares_the_other_nodes_steps(spark, monkeypatch):
    """Of many poor steps beside a hub's good ones none reaches the seed's shuffle."""
    edges = [("hub", f"g{i:03}", "good") for i in range(60)] + [("x", "hub", "mid")] + [("x", f"m{i}", "mid") for i in range(3)] + [(f"m{i}", f"p{i}{j}", "poor") for i in range(3) for j in range(10)]
    weight, rows, union = F.when(F.col("type") == "good", 0.9).when(F.col("type") == "mid", 0.5).otherwise(0.1), [], type(spark.range(1)).unionByName

    def counted(a, b, *x):
        if "seen" in a.columns:
            rows.append(a.count())
        return union(a, b, *x)

    monkeypatch.setattr(type(spark.range(1)), "unionByName", counted)
    seeds = spark.createDataFrame([("s", "x")], "seed string, node string")
    out = G.expand(seeds, spark.createDataFrame(edges, "source string, target string, type string"), weight, 2, 4)
    assert {r["node"] for r in out.filter("round = 2").collect()} == {f"g{i:03}" for i in range(4)}
    assert rows[-1] <= 9  # 1 + 2 * 4 steps of the hub, none of the 33 others
