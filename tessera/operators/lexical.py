"""A stored lexical index and exact top-k over it with bounds on what can still be reached.

Postings lie in blocks of units, a term's in a block by falling weight, with the largest. A search adds up a query's terms in a
block, the one that can add most first. The k-th best sum so far, here or of a first look at rare terms in all blocks, is a
bound: postings of units that can't reach it are skipped, and once the terms left can't together, they are looked up for
units that still can. So a common word isn't multiplied with all queries and units, and the result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.operators.retrieval import QUERIES, best_places, query_terms, term_counts, top_per, unit_postings  # noqa: F401
from tessera.sources.scratch import discard, store

#: Postings of a block, about.
BLOCK = 500_000
#: Terms with more postings than this many times k don't take part in the search for a query's first bound.
PROBE = 50
#: Scores are rounded to 6 digits: what is closer to a bound than that stays.
NEAR = 1e-6


@dataclass
class LexicalIndex:
    """postings: block, term, n, top, at, weights, keys: a row without a term has a block's keys in order, others say where in
    them a term's units are, by falling weight. terms: term, idf, df. Weights are without idf. Both are stored tables."""

    postings: DataFrame
    terms: DataFrame
    blocks: int


def lexical_index(units: DataFrame, key: str, text: str, only: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """An index of units with unique keys; of the terms in the column term of `only`, if given. Texts are read once.

    idf = ln(1 + (N - df + .5) / (df + .5)), weight = tf / (tf + k1 (1 - b + b length / mean length)). Null and empty texts
    count as units without terms; a null key is left out.
    """
    counts = term_counts(units.filter(F.col(key).isNotNull()), key, text, only)
    n, mean, postings = counts.agg(F.sum("copies"), F.sum(F.coalesce("length", F.lit(0)) * F.col("copies")) / F.sum("copies"), F.sum(F.size("terms"))).first()
    n, mean, blocks = float(n or 0), float(mean or 1.0), max(1, -(-(postings or 0) // BLOCK))
    key_type = counts.schema["unit"].dataType
    schema = StructType([StructField("block", IntegerType()), StructField("term", StringType()), StructField("n", LongType()), StructField("top", DoubleType()),
                         StructField("at", ArrayType(IntegerType())), StructField("weights", ArrayType(DoubleType())), StructField("keys", ArrayType(key_type))])

    def by_impact(rows: pa.Table) -> pa.Table:
        names = rows["terms"].combine_chunks().flatten().unique()
        keys, unit, term, weight = unit_postings(rows, names, lambda tf, length: tf / (tf + k1 * (1 - b + b * length / mean)))
        df = np.bincount(term, minlength=len(names))
        both, back = np.unique(term * len(keys) + unit, return_inverse=True)  # rows of one key add up
        weight, term, unit = np.bincount(back, weight), both // len(keys), both % len(keys)
        order = np.lexsort((unit, -weight, term))
        weight, unit, start = weight[order], unit[order], np.searchsorted(term, np.arange(len(names) + 1))
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
        ends = np.append(start, start[-1])  # the last row is the one without a term
        columns = [
            pa.array(np.full(len(names) + 1, rows["block"][0].as_py(), np.int32)), pa.concat_arrays([names, pa.nulls(1, names.type)]), pa.array(np.append(df, 0)),
            pa.array(np.append(weight[start[:-1]], 0.0)), lists(ends, pa.array(unit, pa.int32())), lists(ends, pa.array(weight)), lists(np.append(np.zeros(len(names) + 1), len(keys)), keys),
        ]
        return pa.table(columns, to_arrow_schema(schema))

    block = F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int").alias("block")
    placed = counts.filter(F.size("terms") > 0).select(block, "unit", "length", "copies", "terms", "counts").repartition(blocks, "block")
    postings = store(placed.groupBy("block").applyInArrow(by_impact, schema), "postings")
    df = F.sum("n")
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    terms = store(postings.filter("term is not null").groupBy("term").agg(idf.alias("idf"), df.alias("df")), "terms", 1)
    discard(counts)
    return LexicalIndex(postings, terms, blocks)


def _search(index: pa.Table, queries: pa.Table, k: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Query, unit, score (6 digits) of what may be among each query's k best units, from one block; pairs scored, on a query's
    first row. Queries bring a floor that their k-th best score reaches."""
    named = index.filter(pc.is_valid(index["term"]))
    keys = index.filter(pc.is_null(index["term"]))["keys"].combine_chunks().flatten()
    place = {t: i for i, t in enumerate(named["term"].to_pylist())}
    at, weights = (named[c].combine_chunks().flatten().to_numpy() for c in ("at", "weights"))
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(named["at"].combine_chunks()).to_numpy())]).astype(int) if place else np.zeros(1, int)
    by_unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    for number, (terms, idfs, floor) in enumerate(zip(queries["terms"].to_pylist(), queries["idfs"].to_pylist(), queries["floor"].to_pylist())):
        known = [(idf * weights[start[place[t]]], idf, place[t]) for t, idf in zip(terms, idfs) if t in place]
        known.sort(reverse=True)
        left = np.append(np.cumsum([m for m, _, _ in known][::-1])[::-1], 0.0)  # what the terms from here on can add
        total, scored, done, floor = np.zeros(len(keys)), 0, 0, floor - NEAR
        while done < len(known) and left[done] >= floor:
            most, idf, t = known[done]
            some = slice(start[t], start[t + 1])
            w = weights[some]
            w = w[: np.searchsorted(-w, -(floor - left[0] + most) / idf, side="right")]  # other units can't reach the floor
            total[at[some][: len(w)]] += idf * w
            scored, done = scored + len(w), done + 1
            if len(keys) > k and done & (done - 1) == 0:
                floor = max(floor, np.partition(total, len(keys) - k)[len(keys) - k] - NEAR)
        units = np.nonzero((total > 0) & (total + left[done] >= floor))[0]
        for i in range(done, len(known)):
            _, idf, t = known[i]
            if t not in by_unit:
                some = slice(start[t], start[t + 1])
                order = np.argsort(at[some])
                by_unit[t] = at[some][order], weights[some][order]
            have, w = by_unit[t]
            found = np.minimum(np.searchsorted(have, units), len(have) - 1)
            total[units] += np.where(have[found] == units, idf * w[found], 0.0)
            scored += len(units)
            units = units[total[units] + left[i + 1] >= floor]
        units = units[total[units] >= floor]
        score = np.floor(total[units] * 1e6 + 0.5) / 1e6
        best = best_places(np.zeros(len(units), int), units, score, k)
        out.append((np.full(len(best), number), units[best], score[best], np.where(np.arange(len(best)) == 0, scored, 0)))
    query, unit, score, scored = (np.concatenate(x) for x in zip(*out))
    return queries["q"].combine_chunks().take(pa.array(query)), keys.take(pa.array(unit)), score, scored


def _searched(index: LexicalIndex, asked: DataFrame, floors: DataFrame | None, many: int, k: int) -> DataFrame:
    """q, unit, score, scored: each block's best units of each query, by its terms (q, term, idf) and floor."""
    part = F.pmod(F.xxhash64("q"), F.lit(many)).cast("int")
    number = (F.col("block") * many + F.col("part")).cast("int").alias("number")
    needed = asked.select("term", part.alias("part")).distinct()
    keys = asked.sparkSession.range(many).select(F.lit(None).cast("string").alias("term"), F.col("id").cast("int").alias("part"))
    needed = needed.unionByName(keys).withColumnRenamed("term", "needed")
    left = index.postings.join(needed, F.col("term").eqNullSafe(F.col("needed"))).select(number, "term", "at", "weights", "keys").repartition(index.blocks * many, "number")
    queries = asked.groupBy("q").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"))
    queries = queries.withColumn("floor", F.lit(0.0)) if floors is None else queries.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    right = queries.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1)))).select(number, "q", "terms", "idfs", "floor")
    key_type = index.postings.schema["keys"].dataType.elementType
    schema = StructType([StructField("q", asked.schema["q"].dataType), StructField("unit", key_type), StructField("score", DoubleType()), StructField("scored", LongType())])

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return to_arrow_schema(schema).empty_table()
        return pa.table(_search(rows, queries, k), to_arrow_schema(schema))

    return left.groupBy("number").cogroup(right.groupBy("number")).applyInArrow(search, schema)


def bounded_top_k(index: LexicalIndex, asked: DataFrame, query_key: str, unit_key: str, k: int, counts: dict | None = None) -> DataFrame:
    """query key, unit key, score (6 digits), rank: the k best units of each query (asked: query key, term), ties to smaller
    unit keys. Queries without a known term have no row. `counts`, if given, gets the number of pairs of a query's term and a
    posting: all, and those scored."""
    asked = store(asked.select(F.col(query_key).alias("q"), "term").distinct().join(index.terms, "term"), "asked")
    many = max(1, -(-asked.select("q").distinct().count() // QUERIES))
    best = [F.desc("score"), F.col("unit")]
    # first bound: what the k-th best unit has of rare terms alone
    rare = asked.filter(F.col("df") <= PROBE * k)
    first = store(_searched(index, rare, None, many, k), "first")
    floors = top_per(first, ["q"], best, k).filter(F.col("rank") == k).select("q", (F.col("score") - NEAR).alias("floor"))
    found = _searched(index, asked, floors, many, k)
    if counts is not None:
        found = store(found, "found")
        counts["all"] = asked.agg(F.sum("df")).first()[0] or 0
        counts["probed"] = first.agg(F.sum("scored")).first()[0] or 0
        counts["scored"] = found.agg(F.sum("scored")).first()[0] or 0
    out = top_per(found, ["q"], best, k)
    return out.select(F.col("q").alias(query_key), F.col("unit").alias(unit_key), "score", "rank")
