"""Stored buckets: the rows as they were, no table left in the catalog, and no shuffle where they meet others."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, queries
from tessera.sources.scratch import discard, store

ROWS = [(1, "a"), (1, "a"), (2, None), (None, "b"), (None, None), (3, ""), (7, "x" * 1000)]


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_buckets_hold_the_rows_and_leave_no_table(spark):
    df, before = spark.createDataFrame(ROWS, "k long, `a.b` string").withColumnRenamed("a.b", "text").repartition(3), tables(spark)
    out = store(df, "buckets", buckets="k")
    assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect()), key=repr) == sorted(ROWS, key=repr)
    assert tables(spark) == before and os.path.isdir(out._scratch)
    assert store(df.limit(0), "buckets", buckets="k").count() == 0
    discard(out)
    assert not os.path.exists(out._scratch)
    with pytest.raises(Exception, match="lost"):
        store(df.withColumn("text", F.raise_error(F.lit("lost")).cast("string")), "buckets", buckets="k")
    assert tables(spark) == before


def test_buckets_meet_without_a_shuffle(spark):
    df = store(spark.range(100).withColumn("k", F.col("id") % 7), "buckets", buckets="k")
    assert df.groupBy("k").count().count() == 7 and not exchanges(df.groupBy("k").count())
    assert df.filter("id < 50").groupBy("k").count().agg(F.sum("count")).first()[0] == 50


def test_links_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, None), (2, "the cat sat"), (None, "")], "doc_id long, text string").repartition(2)
    out = alignment.aligned(df, queries.aligned_sides(), keep_groups=False)
    # of the two sides that meet by chunk only the dictionaries' entries
    assert len([x for x in exchanges(out) if "hashpartitioning(chunk" in x]) == 1
    assert {(r["doc_id"], r["n_groups"] > 0) for r in out.collect()} == {(1, True), (2, False), (2, True), (None, False)}
