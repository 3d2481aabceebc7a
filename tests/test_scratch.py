"""Stored tables take the disk of their rows only."""

from pyspark.sql import functions as F

from tessera.sources import scratch


def test_what_was_shuffled_for_a_table_goes_when_it_is_stored(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size())) if "shuffle_" in str(f)}
    before, setting = shuffled(), spark.conf.get(scratch.CLEANUP, None)
    table = scratch.store(spark.range(10000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")), "counts")
    again = scratch.store(spark.range(10000).repartition(5, "id"), "rows")
    assert not shuffled() - before
    assert sum(r.n for r in table.collect()) == 10000 and again.count() == 10000 and spark.conf.get(scratch.CLEANUP, None) == setting
    scratch.discard(table, again)
