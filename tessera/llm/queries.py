"""The thin queries opN_<name>: each applies its operator with production parameters and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, hmm, toxicity
from .dual_tree import clusters
from .exact_search import exact_top_k
from .fast_ids import byte_level_ids, word_ids
from .packing import pack
from .pii import KINDS, personal_data, spans_string
from .prefix_bpe import encode_documents
from .quality import quality
from .simhash import near_duplicates
from .stream_bpe import transduce
from .token_counts import token_counts
from .token_store import read_documents, write_tokens

END_ID = 1
SEQUENCE = 2048


def byte_encoder():
    """Encoder of byte_bpe_50k.json; the paths are fixed on the driver and must exist on every executor."""
    vocab, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return lambda text: byte_level_ids(text, vocab, ranks, pattern)


def word_encoder():
    vocab = public_tokenizers.path("word_bpe_49k.json")
    return lambda text: word_ids(text, vocab)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def piece_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_columns(pack(common.documents(spark, sf_dir), byte_encoder(), END_ID, SEQUENCE))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(common.documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_string(F.col("base")), 256).alias("base_sha256"), spans_string(F.concat("base", "terms")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), parts AS (
  SELECT row, vec_id, len(vec) AS dim, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v
), scored AS (
  SELECT q.row AS asked, c.row AS found, any_value(q.vec_id) AS query_id, any_value(c.vec_id) AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY 1, 2
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    write_tokens(common.documents(spark, sf_dir), path, word_encoder(), END_ID)
    out = read_documents(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(common.documents(spark, sf_dir))


def aligned_sides():
    """Both tokenizers of op11; the paths are fixed on the driver and must exist on every executor."""
    names = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
    (vocab, ranks, model), pattern = (public_tokenizers.path(x) for x in names), public_tokenizers.PATTERN
    return lambda: (alignment.byte_side(vocab, ranks, pattern), alignment.piece_side(model))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(common.documents(spark, sf_dir), aligned_sides(), keep_groups=False)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Vectors and centroids as one row a component."""
    parts = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), v AS (
  SELECT row, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM kept
), first AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec) - 1 AS c, vec FROM kept QUALIFY c < {k}
), c0 AS (
  SELECT c, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM first
)"""
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""
d{t} AS (
  SELECT row, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS distance FROM v JOIN c{t} m USING (i) GROUP BY row, c
), a{t} AS (
  SELECT row, c, distance FROM d{t} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1
)"""
        )
        if t < rounds:
            parts.append(
                f"""
s{t} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN v USING (row) GROUP BY c, i
), c{t + 1} AS (
  SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{t} m LEFT JOIN s{t} USING (c, i)
)"""
            )
    last = f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (row)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)
"""
    return ",".join(parts) + last


def op13_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transduce(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    first = (op1_quality, op2_byte_bpe, op3_packing, op4_pii, op5_toxicity, op6_exact_search, op7_simhash, op8_token_counts, op9_token_store, op10_lm_scoring)
    return {f.__name__: f for f in (*first, op11_token_alignment, op12_clusters, op13_stream_bpe)}


def oracle_sql() -> dict:
    return {"op6_exact_search": OP6_SQL, "op12_clusters": _op12_sql()}
