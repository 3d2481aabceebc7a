"""The mergeable fingerprint: order, repeats, parts."""

from tessera.operators.relational import fingerprint_lanes, merged_lanes, multiset_fingerprint, sealed


def prints(df):
    return {r["g"]: (r["fingerprint"], r["n"]) for r in multiset_fingerprint(df, ["a", "b"], ["g"]).collect()}


def test_order_and_partitions_do_not_matter_but_content_does(spark):
    rows = [(i % 3, i, None if i % 5 == 0 else f"t{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, a int, b string")
    first = prints(df)
    assert first == prints(df.orderBy("b").repartition(7)) and {n for _, n in first.values()} == {100}
    assert prints(df.unionByName(df.limit(1)))[rows[0][0]] != first[rows[0][0]]
    changed = spark.createDataFrame([(g, a, "other" if a == 4 else b) for g, a, b in rows], "g int, a int, b string")
    assert {g for g, v in prints(changed).items() if v != first[g]} == {1}
    assert prints(df.limit(0)) == {}


def test_parts_merge_into_the_whole(spark):
    df = spark.createDataFrame([(i % 4, i, "x" * (i % 9)) for i in range(500)], "g int, a int, b string")
    old, new = fingerprint_lanes(df.filter("a < 350"), ["a", "b"], ["g"]), fingerprint_lanes(df.filter("a >= 350"), ["a", "b"], ["g"])
    merged = sealed(merged_lanes(old.unionByName(new), ["g"]), ["g"])
    assert {r["g"]: (r["fingerprint"], r["n"]) for r in merged.collect()} == prints(df)
