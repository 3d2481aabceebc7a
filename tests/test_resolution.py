"""Folding outcomes: any order, batches and restarts give the same candidates; the decision against a plain ladder."""

import random

import pytest

from tessera.streaming import resolution as S

SCHEMA = "record_id string, candidate_id string, role string, required boolean, provider string, url string, state string, reasons array<string>, identity_match boolean, trusted boolean, seq long"
STATES = ["FETCH_PENDING", "DISCOVERED", "BLOCKED", "NEEDS_REVIEW", "FETCHED", "AUTO_EXACT_SHA", None]


def outcomes(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        record = "hot" if rng.random() < 0.3 else f"r{rng.randrange(60)}"
        slot = rng.randrange(4)
        role = ["IDENTITY", "STATUS_HISTORY", "BINARY", "BINARY"][slot]
        reasons = rng.sample(["HTTP_404", "FETCH_ERROR", "SHA_MISMATCH"], rng.randrange(3))
        out.append((record, f"c{slot}", role, slot == 2, rng.choice(["p", "longer"]), f"u{slot}", rng.choice(STATES), rng.choice([reasons, None]), rng.choice([True, False, None]), rng.choice([True, False, None]), seq))
    return out


def standing(rows):
    """Candidates by walking the outcomes in order."""
    out = {}
    for row in sorted(rows, key=lambda r: r[10]):
        old = out.get(row[:2])
        pending = row[6] in (None, "FETCH_PENDING", "DISCOVERED")
        had_evidence = old is not None and old[6] not in (None, "FETCH_PENDING", "DISCOVERED", "BLOCKED")
        if had_evidence or (old is not None and pending and old[6] == "BLOCKED"):
            continue
        out[row[:2]] = row
    return out


def ladder(candidates):
    """state, reasons, blocking of one record, step by step."""
    tried = [c for c in candidates if c["state"] not in ("FETCH_PENDING", "DISCOVERED", None)]
    binaries = [c for c in candidates if c["role"] == "BINARY"]
    best = None
    for c in tried:
        if c["role"] != "BINARY" or c["state"] == "BLOCKED":
            continue
        rank = 0 if not c["trusted"] else 2 + 2 * (c["state"] == "AUTO_EXACT_SHA") + bool(c["identity_match"])
        key = (rank, -len(c["provider"]), c["provider"], c["url"], c["candidate_id"])
        if best is None or key > best[0]:
            best = (key, c)
    trusted = best is not None and best[0][0] > 0
    named = any(c["identity_match"] and c["state"] != "BLOCKED" for c in tried)
    tried_binaries = [c for c in tried if c["role"] == "BINARY"]
    added = []
    if tried_binaries and not trusted and all(c["state"] == "BLOCKED" for c in tried_binaries):
        state = "BLOCKED"
    elif best is None and any(c["required"] and c not in tried for c in candidates):
        state, added = "FETCH_PENDING", ["BINARY_NOT_FETCHED"]
    elif best is None and all(c["state"] == "BLOCKED" for c in candidates):
        state = "BLOCKED"
    elif best is None:
        state, added = "NEEDS_REVIEW", ["BINARY_NOT_FETCHED"]
    elif best[1]["state"] != "AUTO_EXACT_SHA":
        state, added = "NEEDS_REVIEW", best[1]["reasons"] or []
    elif not named:
        state, added = "NEEDS_REVIEW", ["IDENTITY_FAILED"]
    else:
        state = "AUTO_EXACT_SHA"
    reasons = {r for c in tried for r in c["reasons"] or []} | set(added)
    barred = [c for c in tried if c["state"] == "BLOCKED" and not (trusted and named) and not (c["role"] != "BINARY" and binaries)]
    blocking = {r for c in barred for r in c["reasons"] or []}
    return state, sorted(reasons), sorted(blocking)


def decided(candidates, **more):
    return {r.record_id: (r.state, r.reasons, r.blocking) for r in S.record_decisions(candidates, **more).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_decisions_by_brute_force(spark, seed):
    rows = outcomes(600, seed)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    want = {}
    for row in standing(rows).values():
        want.setdefault(row[0], []).append(dict(zip(names, row)))
    shuffled = rows + random.Random(seed).sample(rows, 100)  # replays change nothing
    random.Random(seed).shuffle(shuffled)
    got = decided(S.fold(spark.createDataFrame(shuffled, SCHEMA)))
    assert got == {record: ladder(cs) for record, cs in want.items()}


def test_restarts_give_the_states_of_one_run(spark, tmp_path):
    rows = outcomes(400, 7)
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    assert S.persisted(spark, target).count() == 0
    for start in range(0, 400, 100):
        spark.createDataFrame(rows[start : start + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        S.resolve_stream(stream, target, checkpoint).awaitTermination()
    once = S.fold(spark.createDataFrame(rows, SCHEMA))
    assert sorted(S.persisted(spark, target).collect()) == sorted(once.collect())
    # the folded candidates are the query's state: a run without news adds no rows
    before = spark.read.parquet(target).count()
    S.resolve_stream(spark.readStream.schema(SCHEMA).parquet(source), target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == before


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.fold(empty).count() == 0 and decided(empty) == {}
    records = spark.createDataFrame([("a",), ("a",), (None,)], "record_id string")
    assert decided(S.fold(empty), records=records) == {"a": ("NEEDS_REVIEW", ["BINARY_NOT_FETCHED"], [])}
    nulls = spark.createDataFrame([(None, "c") + (None,) * 9, ("r", None) + (None,) * 9, ("r", "c") + (None,) * 9], SCHEMA)
    assert S.fold(nulls).count() == 1
    assert decided(S.fold(nulls))["r"] == ("NEEDS_REVIEW", ["BINARY_NOT_FETCHED"], [])
