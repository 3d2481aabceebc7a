"""Rows that an order leaves open."""

from tessera.plans import relational


def test_lines_of_equal_price_and_number_have_one_order(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(1, part, supplier, 1, 5.0) for supplier in (7, 3, 9, 1, 8, 2, 6) for part in (4, 2)]
    want = [(1, s, 1, i + 1) for i, s in enumerate(sorted({r[2] for r in rows})[:6])]
    for lines in (rows, rows[::-1], sorted(rows)):  # dealt over several tasks, which hand rows on in no order
        df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").repartition(3)
        monkeypatch.setattr(relational, "table", lambda spark, sf_dir, name, df=df: df)
        assert sorted(map(tuple, relational.q_diversity(spark, "").collect()), key=lambda r: r[3]) == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_prices_and_numbers_come_last_as_in_the_sql(spark, monkeypatch):
    import duckdb

    from tessera.plans import registry

    rows = [(o, 1, s, n, x) for o in (1, 2, 3, None) for s, n, x in ((7, None, 5.0), (3, 2, 5.0), (9, 1, None), (9, None, 5.5), (4, 3, None), (9, 4, 5.5), (None, 5, 5.0))]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double"
    monkeypatch.setattr(relational, "table", lambda spark, sf_dir, name: spark.createDataFrame(rows, kind))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_extendedprice DOUBLE)")
    duck.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", rows)
    want = duck.execute(registry.oracle_sql()["q_diversity"]).fetchall()
    assert sorted(map(tuple, relational.q_diversity(spark, "").collect()), key=str) == sorted(want, key=str) and len(want) > 10
