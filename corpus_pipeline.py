"""The corpus pipeline: five operators, each over all rows that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of docs. Null texts are empty
texts: the quality rules reject them. Null ids pass every filter; repeated rows are copies, of which the near-duplicate
stage keeps one; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common
from tessera.llm.packing import pack
from tessera.llm.pii import sanitise
from tessera.llm.quality import keep_good
from tessera.llm.queries import END_ID, SEQUENCE, byte_encoder, piece_columns
from tessera.llm.simhash import keep_one_of_each
from tessera.llm.toxicity import keep_clean, train
from tessera.sources import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, doesn't call toxic."""
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links at up to 4 differing bits over four-word shingles, and wherever
    the five-word shingles of two texts have a Jaccard similarity of 0.8 or more."""
    return keep_one_of_each(docs, threshold=4, shingle=4, alike=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and what discloses it replaced in their texts."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of fixed length."""
    return piece_columns(pack(docs, byte_encoder(), END_ID, SEQUENCE))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: Model fitting and connected components aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result stored before the next stage reads it. What a stage has stored besides is
    deleted then."""
    out, others = common.documents(spark, sf_dir), scratch.written()
    for name, stage in STAGES[:-1]:
        out = common.materialize(stage(spark, out, sf_dir), f"stage-{name}")
        scratch.release(keep=others | {out._scratch})
    return STAGES[-1][1](spark, out, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
