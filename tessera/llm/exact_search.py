"""Exact top-k by inner product with a table of distances to pivots.

|d(q, p) - d(x, p)| <= d(q, x) for every pivot p, so the largest of these over the pivots bounds the distance from
below, and with it the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Candidates are scored in the order of that
bound until it falls below the k-th best score, or below the k-th best score among a bounded sample of all rows, which
holds for every block. Candidates and queries are dealt out in blocks of fixed sizes, and a task takes one block of each,
so no task and no broadcast grows with the data; only the sample and the pivots chosen from it go to every task. Each
block of queries meets each block of rows: that work is the number of queries times that of rows, stated and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of a sample: the first row, then always the row farthest from those chosen."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T))


def floors(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among sampled rows with another id: less can't be among the k best of all rows."""
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    scores = np.where(query_ids[:, None] == sample_ids, -np.inf, queries.astype(np.float64) @ sample.T)
    best = np.partition(scores, -k, axis=1)[:, -k]
    return best - 1e-9 * np.abs(best)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[tuple], int]:
    """(query position, id, score) of each query's k best rows with another id, ties to smaller ids; rows scored. What
    scores below a query's floor may be left out.

    Integers; their products are summed exactly: as doubles below 2^53, else as 64-bit integers.
    """
    d = rows.shape[1]
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1) < 2**53
    fx, fq = rows.astype(np.float64), queries.astype(np.float64)
    sx, sq = (fx**2).sum(axis=1), (fq**2).sum(axis=1)
    table, asked = _distances(fx, pivots), _distances(fq, pivots)
    slack = 1e-7 * (1 + np.sqrt(max(sx.max(initial=0), sq.max(initial=0))))
    out, scored = [], 0
    for i in range(len(queries)):
        below = np.abs(table - asked[i]).max(axis=1, initial=0) - slack
        bound = (sq[i] + sx - np.maximum(0, below) ** 2) / 2 + slack
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != query_ids[i]]
        best_score, best_id, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * k
        least = -np.inf if floor is None else floor[i]
        while at < len(order) and bound[order[at]] >= (max(least, best_score[-1]) if len(best_score) == k else least):
            part = order[at : at + step]
            score = (fx[part] @ fq[i]).astype(np.int64) if exact else rows[part] @ queries[i]
            all_score, all_id = np.concatenate((best_score, score)), np.concatenate((best_id, ids[part]))
            top = np.lexsort((all_id, -all_score))[:k]
            best_score, best_id = all_score[top], all_id[top]
            at, step, scored = at + len(part), 2 * step, scored + len(part)
        out += [(i, int(b), int(s)) for b, s in zip(best_id, best_score)]
    return out, scored


def exact_top_k(df: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, n_pivots: int = 128, pivot_sample: int = 1024, block_rows: int = 2048, block_queries: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors of its own dimension.

    Queries are the rows whose id is divisible by `query_every`. Vectors that are null or hold a null or non-finite
    component, and rows with a null id, take no part. Repeated rows are separate candidates and separate queries; a
    query's own id is left out. Ties go to smaller ids. Fewer than k candidates give fewer rows; an empty table none.
    Other columns are ignored. Magnitudes over 2^28 after scaling are out of range for an exact 64-bit sum.
    """
    vec = F.col("vec")
    rows = df.select(common.column(id_col).cast("long").alias("vec_id"), common.column(vector_col).alias("vec"))
    unfit = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & vec.isNotNull() & ~unfit).select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    n = rows.count()
    is_query = F.col("vec_id") % query_every == 0
    n_queries = rows.filter(is_query).count()
    n_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_queries))
    pivots: dict[int, np.ndarray] = {}
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_sample).collect():
        drawn.setdefault(len(r["vec"]), []).append((r["vec_id"], r["vec"]))
    for d, some in drawn.items():
        sample[d] = np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.float64).reshape(len(some), d)
        pivots[d] = choose_pivots(sample[d][1], n_pivots)

    here = F.size("vec").alias("dim")
    candidates = rows.select("vec_id", "vec", here, F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    queries = rows.filter(is_query).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", here)
    queries = queries.select("*", F.pmod(F.xxhash64("vec_id", "row"), F.lit(q_blocks)).cast("int").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(key, found: pa.Table, asked: pa.Table) -> pa.Table:
        d = key[0].as_py()
        matrix = lambda t: np.asarray(t["vec"].combine_chunks().flatten(), np.int64).reshape(t.num_rows, d)
        q, q_ids, (s_ids, s) = matrix(asked), asked["vec_id"].to_numpy(), sample.get(d, (np.empty(0, np.int64), np.empty((0, d))))
        pairs, _ = best_of_block(q, q_ids, matrix(found), found["vec_id"].to_numpy(), pivots.get(d, np.empty((0, d))), k, floors(q, q_ids, s, s_ids, k))
        at = np.array([p[0] for p in pairs], np.int64)
        return pa.table({"query_id": asked["vec_id"].to_numpy()[at], "row": asked["row"].to_numpy()[at], "vec_id": np.array([p[1] for p in pairs], np.int64), "score": np.array([p[2] for p in pairs], np.int64)})

    keys = ["dim", "q_block", "block"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
