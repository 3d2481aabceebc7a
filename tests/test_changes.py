"""Changes applied to versions, case by case, and against a plain walk."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from tessera.operators.changes import applied_changes, checked_versions, placed_changes

V, C = "identity string, version_id string, valid_from date, valid_to date", "change_id string, identity string, operation string, effective_from date, review_status string"
D = lambda y, m=1, d=1: date(y, m, d)


def test_each_reason(spark):
    versions = spark.createDataFrame([("i", "v1", D(2000), D(2010)), ("i", "v2", D(2010), None), ("j", "w", D(2000), None)], V)
    rows = [
        ("ok", "i", "AMEND", D(2005), "APPROVED"), ("draft", "i", "AMEND", D(2006), "DRAFT"), ("odd", "i", "RENAME", D(2006), "APPROVED"), ("undated", "i", "AMEND", None, "APPROVED"),
        ("a", "i", "AMEND", D(2007), "APPROVED"), ("b", "i", "REPEAL", D(2007), "APPROVED"), ("early", "i", "AMEND", D(1999), "APPROVED"), ("other", "k", "AMEND", D(2005), "APPROVED"),
        ("start", "i", "REPLACE", D(2010), "APPROVED"), ("end", "j", "REPEAL", D(2003), "APPROVED"), ("late", "j", "AMEND", D(2004), "APPROVED"), (None, "i", "AMEND", D(2012), None),
    ]
    got = {r["change_id"]: r["reason"] for r in placed_changes(versions, spark.createDataFrame(rows, C)).collect()}
    assert got == {"ok": None, "draft": "NOT_APPROVED", "odd": "UNKNOWN_OPERATION", "undated": "MISSING_DATE", "a": "CONFLICT", "b": "CONFLICT", "early": "NOT_IN_FORCE", "other": "NOT_IN_FORCE", "start": "AT_START", "end": None, "late": "AFTER_REPEAL", None: "NOT_APPROVED"}


def test_unsound_versions_are_refused(spark):
    rows = [("i", "v1", D(2000), D(2011)), ("i", "v2", D(2010), None), ("j", "w1", D(2000), None), ("j", "w2", D(2001), None), ("k", "x", D(2000), D(2000)), ("l", "y", None, None), ("m", "z", D(2000), D(2001))]
    df = spark.createDataFrame(rows, V)
    assert {r["version_id"]: r["problem"] for r in checked_versions(df).collect()} == {"v1": "OVERLAP", "v2": None, "w1": "OVERLAP", "w2": None, "x": "EMPTY_INTERVAL", "y": "MISSING_START", "z": None}
    with pytest.raises(ValueError, match="unsound"):
        applied_changes(df, spark.createDataFrame([], C))


def test_against_a_plain_walk(spark):
    rng = random.Random(8)
    versions, changes = [], []
    for i in range(40):
        at = D(2000) + timedelta(days=rng.randint(0, 300))
        for j in range(rng.randint(1, 3)):
            end = None if rng.random() < 0.3 else at + timedelta(days=rng.randint(1, 400))
            versions.append((f"i{i}", f"i{i}v{j}", at, end))
            if end is None:
                break
            at = end + timedelta(days=rng.choice([0, 0, 30]))
    for c in range(400):
        changes.append((f"c{c}", f"i{rng.randint(0, 42)}", rng.choice(["AMEND", "REPLACE", "REPEAL"]), D(2000) + timedelta(days=rng.randint(0, 1200)), rng.choice(["APPROVED"] * 4 + [None])))
    held = defaultdict(list)
    for c in changes:
        if c[4] == "APPROVED":
            held[c[1], c[3]].append(c)
    want = []
    for identity, version, start, end in versions:
        own = sorted(cs[0][3:4] + cs[0] for (i, day), cs in held.items() if i == identity and len(cs) == 1 and start < day and (end is None or day < end))
        begin, by = start, None
        for day, change, _, operation, *_ in own:
            want.append((identity, begin, day, version, by, change))
            begin, by = (None, None) if operation == "REPEAL" else (day, change)
            if begin is None:
                break
        if begin is not None:
            want.append((identity, begin, end, version, by, None))
    out = applied_changes(spark.createDataFrame(versions, V), spark.createDataFrame(changes, C))
    got = [tuple(r[c] for c in ("identity", "valid_from", "valid_to", "base_version", "introduced_by", "ended_by")) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out.select("version_id").distinct().count() == len(want)
