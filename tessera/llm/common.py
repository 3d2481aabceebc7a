"""Shared pieces: reading documents, scratch tables that outlive executors, text constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import discard
from tessera.sources.scratch import release as release_scratch
from tessera.sources.scratch import scratch_path
from tessera.sources.scratch import store as materialize

__all__ = ["bitmap", "column", "discard", "documents", "id_and_text", "in_bitmap", "materialize", "named_as", "placed", "release_scratch", "scratch_path", "small_batches"]

#: Fixed by the query contracts: a word is a run of anything but ASCII white space.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that other columns can't clash."""
    return df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))


def placed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named by their places, so that what an operator adds can't clash, and the new names of some."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def named_as(out: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of placed(df) in `out`, under df's names."""
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)])


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds each Arrow batch by bytes, so that a run of long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


BITMAP_BITS, BITMAP_HASHES = 1 << 21, 3


def _bits(value) -> list[Column]:
    """The bits of a value: parts of one 64-bit hash, so that a frequent value doesn't pass by one chance hit."""
    return [F.shiftrightunsigned(F.xxhash64(value), 21 * i).bitwiseAND(F.lit(BITMAP_BITS - 1).cast("long")) for i in range(BITMAP_HASHES)]


def bitmap(wanted: DataFrame, value: str, name: str) -> Column:
    """The wanted values as a column that holds a bitmap of fixed size, whatever their number: a scalar subquery, so that
    no plan carries it as text. It sorts out rows before a shuffle; the join after it stays exact."""
    bit = F.explode(F.array(*_bits(value))).alias("b")
    marks = wanted.select(bit).groupBy(F.shiftright("b", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    words = wanted.sparkSession.range(0, BITMAP_BITS // 64, 1, 1).join(F.broadcast(marks), "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return words.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits")).scalar().alias(name)


def in_bitmap(value: Column, name: str) -> Column:
    """Whether a value can be wanted, by the bitmap in that column."""
    hit = None
    for bit in _bits(value):
        set_ = F.getbit(F.get(F.col(name), F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        hit = set_ if hit is None else hit & set_
    return hit
