"""Ranked retrieval: lexical and dense channels, fusion, reranking, exact and overlap look-ups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import tokens
from tessera.session import small_batches
from tessera.sources.scratch import store


def postings(units: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: one row per unit and distinct term."""
    words = units.select(F.col(key), tokens(F.col(text)).alias("words"))
    exploded = words.select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return exploded.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


#: Pairs of a query's term and a posting that one task adds up; in arrays, where a pair costs far less, FOLD times as many.
PAIRS, FOLD = 1_000_000, 4
#: Queries of a block at most; cells (queries by units) and pairs of an array at most, but for a single unit.
QUERIES, CELLS = 1024, 4_000_000
#: Asked terms that go to the tasks, which drop other words early. If there are more, all words wait for the join.
ASKED = 65_536


def parts(frequency: DataFrame, asked: DataFrame, pairs: int) -> int:
    """How many parts of about so many pairs the postings (term, df) of the asked terms make."""
    both = frequency.join(asked.groupBy("term").agg(F.count("*").alias("m")), "term")
    return max(1, -(-(both.agg(F.sum(F.col("df") * F.col("m"))).first()[0] or 0) // pairs))


def dealt(found: DataFrame, by: str, n: int) -> DataFrame:
    """Postings dealt out by a column to n tasks."""
    return found.repartition(n, by)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(F.col(key), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def _words_counted(rows: DataFrame, asked: pa.Array | None) -> DataFrame:
    """unit, length, terms, counts of rows (unit, words): each row's distinct words, of the asked ones if given."""

    def count(batches):
        for batch in batches:
            words, n = batch["words"], batch.num_rows
            flat, length = words.flatten(), pc.list_value_length(words)
            if asked is None:
                flat = flat.dictionary_encode()
                names, term = flat.dictionary, flat.indices
            else:
                names, term = asked, pc.index_in(flat, asked)
            row = np.repeat(np.arange(n), length.fill_null(0).to_numpy())[term.is_valid().to_numpy(zero_copy_only=False)]
            both, tf = np.unique(row * len(names) + term.drop_null().to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(both, np.arange(n + 1) * len(names)), pa.int32())
            terms = names.take(pa.array(both % max(1, len(names))))
            lists = [pa.ListArray.from_arrays(at, x) for x in (terms, pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["unit"], length, *lists], ["unit", "length", "terms", "counts"])

    small_batches(rows.sparkSession)
    schema = StructType([rows.schema["unit"]]).add("length", IntegerType()).add("terms", ArrayType(StringType())).add("counts", ArrayType(IntegerType()))
    return rows.mapInArrow(count, schema)


def term_counts(units: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """A stored table of unit, length, copies, terms, counts: one row per unit key and length with its distinct words (of the
    column term of `only`, if given) and their numbers. Where several units share both, copies says how many and a word may
    stand in the lists once for each. Null texts have a null length. Texts are read and split once."""
    some = None if only is None else only.select("term").distinct().limit(ASKED + 1).collect()
    few = None if some is None or len(some) > ASKED else pa.array([r["term"] for r in some], pa.string())
    rows = _words_counted(units.select(F.col(key).alias("unit"), tokens(F.col(text)).alias("words")), few)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "counts")]
    rows = store(rows.groupBy("unit", "length").agg(F.count("*").alias("copies"), *lists), "term-counts")
    if only is None or few is not None:
        return rows
    each = rows.select("unit", "length", "copies", F.explode_outer(F.arrays_zip("terms", "counts")).alias("x"))
    each = each.select("unit", "length", "copies", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    each = each.join(only.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left")
    pair = F.when(F.col("wanted"), F.struct(F.col("term").alias("t"), F.col("tf").alias("c")))  # collect_list leaves nulls out
    kept = each.groupBy("unit", "length", "copies").agg(F.collect_list(pair).alias("x"))
    return store(kept.select("unit", "length", "copies", F.col("x.t").alias("terms"), F.col("x.c").alias("counts")), "term-counts")


def best_places(query: np.ndarray, order: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where each query's k best scores stand, ties to smaller orders."""
    best = np.lexsort((order, -score, query))
    rank = np.arange(len(best)) - np.searchsorted(query[best], query[best], side="left")
    return best[rank < k]


def unit_postings(units: pa.Table, names: pa.Array, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the units in order, then the postings of the named terms: a unit's and a term's place, weight."""
    keys, lists = units["unit"].combine_chunks(), units["terms"].combine_chunks()
    term = pc.index_in(lists.flatten(), names).fill_null(-1).to_numpy()
    row, tf = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy()), units["counts"].combine_chunks().flatten().to_numpy().astype(float)
    row, tf, term = row[term >= 0], tf[term >= 0], term[term >= 0]
    if (units["copies"].to_numpy() > 1).any():  # a word's numbers in units of one key and length are one number
        both, back = np.unique(row * len(names) + term, return_inverse=True)
        row, term, tf = both // len(names), both % len(names), np.bincount(back, tf)
    weight = weigh(tf, units["length"].to_numpy()[row])
    places = pc.sort_indices(keys, null_placement="at_start").to_numpy()
    new = np.ones(len(places), bool)
    if len(places) > 1:
        here, before = keys.take(pa.array(places[1:])), keys.take(pa.array(places[:-1]))
        same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(here.is_null(), before.is_null()))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    order = np.empty(len(places), np.int64)  # alike for rows of one key
    order[places] = np.cumsum(new) - 1
    return keys.take(pa.array(places[new])), order[row], term, weight


def _scores(left: pa.Table, right: pa.Table, k: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Query, unit and score (6 digits) of each query's k best units in a block of units by a block of queries: the pairs of a
    query's term and a posting are laid out in arrays, some units at a time, and added up by cell."""
    lists = right["terms"].combine_chunks()
    names = lists.flatten().unique()
    asked = pc.index_in(lists.flatten(), names).to_numpy()
    by_term = np.argsort(asked, kind="stable")
    query = np.repeat(np.arange(right.num_rows), pc.list_value_length(lists).to_numpy())[by_term]
    idf, start = right["idfs"].combine_chunks().flatten().to_numpy()[by_term], np.searchsorted(asked[by_term], np.arange(len(names) + 1))
    keys, unit, term, weight = unit_postings(left, names, weigh)
    by_unit = np.argsort(unit, kind="stable")
    unit, term, weight = unit[by_unit], term[by_unit], weight[by_unit]
    n, nq = len(keys), right.num_rows
    first = np.searchsorted(unit, np.arange(n + 1))  # each unit's postings
    pairs = np.concatenate([[0], np.cumsum(np.diff(start)[term])])[first]
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    at = 0
    while at < n:
        most = np.searchsorted(pairs, pairs[at] + CELLS, side="right") - 1
        to = max(at + 1, min(n, at + max(1, CELLS // nq), int(most)))
        some = slice(first[at], first[to])
        m = np.diff(start)[term[some]]
        each = np.repeat(np.arange(some.start, some.stop), m)
        with_ = start[term[each]] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
        cells = np.bincount(query[with_] * (to - at) + unit[each] - at, weight[each] * idf[with_], nq * (to - at)).reshape(nq, -1)
        score = np.floor(cells * 1e6 + 0.5) / 1e6
        if to - at > k:
            bound = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            q, u = np.nonzero((cells > 0) & (score >= bound))
        else:
            q, u = np.nonzero(cells > 0)
        held = tuple(np.concatenate(x) for x in zip(held, (q, u + at, score[q, u])))
        best = best_places(*held, k)
        held = tuple(x[best] for x in held)
        at = to
    return right["query"].combine_chunks().take(pa.array(held[0])), keys.take(pa.array(held[1])), held[2]


def bm25(units: DataFrame, unit_key: str, unit_text: str, queries: DataFrame, query_key: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query key, unit key, score, rank: the k best units of each query.

    idf = ln(1 + (N - df + .5) / (df + .5)), weight = tf / (tf + k1 (1 - b + b length / mean length)). The asked words of each
    unit are stored; blocks of units meet blocks of queries, and of each pair of blocks only every query's k best units leave
    the task. Ties go to smaller unit keys.
    """
    asked = store(query_terms(queries, query_key, query_text).distinct(), "asked-terms")
    found = term_counts(units, unit_key, unit_text, asked)
    n, mean = found.agg(F.sum("copies"), F.sum(F.col("length") * F.col("copies")) / F.sum(F.when(F.col("length").isNotNull(), F.col("copies")))).first()
    n, mean = float(n or 0), float(mean or 1.0)
    words = F.when(F.col("copies") > 1, F.array_distinct("terms")).otherwise(F.col("terms"))
    frequency = store(found.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequency", 1)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    many = max(1, -(-asked.select(query_key).distinct().count() // QUERIES))
    postings = frequency.agg(F.sum("df")).first()[0] or 0
    n_blocks = max(-(-parts(frequency, asked, FOLD * PAIRS) // many), -(-postings // (FOLD * PAIRS)), 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = (F.col("u") * many + F.col("q")).cast("int").alias("block")
    left = found.filter(F.size("terms") > 0).withColumn("u", block("unit", n_blocks)).withColumn("q", every(many))
    left = dealt(left.select(number, "unit", "length", "copies", "terms", "counts"), "block", n_blocks * many)
    known = asked.join(frequency, "term").select(F.col(query_key).alias("query"), "term", idf.alias("idf"))
    known = known.groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"))
    right = known.withColumn("q", block("query", many)).withColumn("u", every(n_blocks)).select(number, "query", "terms", "idfs")
    schema = StructType([StructField(query_key, known.schema["query"].dataType), StructField(unit_key, found.schema["unit"].dataType), StructField("score", DoubleType())])

    def best(units: pa.Table, queries: pa.Table) -> pa.Table:
        if not units.num_rows or not queries.num_rows:
            return to_arrow_schema(schema).empty_table()
        weigh = lambda tf, length: tf / (tf + k1 * (1 - b + b * length / mean))
        return pa.table(_scores(units, queries, k, weigh), to_arrow_schema(schema))

    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(best, schema)
    return top_per(scored, [query_key], [F.desc("score"), F.col(unit_key)], k)


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


#: Rows of a block of vectors, at least and at most, and those of one product with a block.
BLOCKS, SLAB = (2048, 16384), 512


def _largest(score: np.ndarray, k: int, near: float = 2e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of at least each row's k largest scores and what comes close to them. A bound is the k-th
    largest of the maxima of groups of columns: so many columns reach it."""
    wide = 32 if score.shape[1] >= 64 * k else 1
    maxima = score[:, : score.shape[1] // wide * wide].reshape(len(score), -1, wide).max(axis=2) if wide > 1 else score
    if maxima.shape[1] > k:
        bound = -np.partition(-maxima, k - 1, axis=1)[:, k - 1 : k] - near
        i, j = np.nonzero(~(score < bound))  # scores that aren't numbers stay, as before
    else:
        i, j = (x.ravel() for x in np.indices(score.shape))
    return i, j, score[i, j]


def dense_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """query_id, neighbour_id, score, rank by inner product in doubles, rounded to 6 digits; own key left out.

    Both sides are dealt out in blocks of bounded size (an eighth of the rows, within BLOCKS, unless given) and every pair of
    blocks is a matrix product, made a few rows at a time, so neither side is ever broadcast or held whole.
    """
    narrow = all(dict(df.dtypes)[vector] == "array<float>" for df in (queries, rows))  # doubles are made of them in the tasks
    clean = lambda df: df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(vector) if narrow else F.col(vector).cast("array<double>")).alias("v"))
    asked, have = clean(queries), clean(rows)
    n, m = asked.count(), have.count()
    block = block or max(BLOCKS[0], min(BLOCKS[1], -(-m // 8)))
    a, b = max(1, -(-n // block)), max(1, -(-m // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("id", "v", deal(a).alias("qa"), every(b).alias("rb"))
    have = have.select("id", "v", deal(b).alias("rb"), every(a).alias("qa"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        m = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        out = {"query_id": [], "neighbour_id": [], "score": []}
        if left.num_rows and right.num_rows:
            asked, have = m(left), np.ascontiguousarray(m(right).T)
            ids, own = right["id"].to_numpy(), left["id"].to_numpy()
            for at in range(0, len(own), SLAB):
                i, j, score = _largest(asked[at : at + SLAB] @ have, k + 1)
                i, score = own[at + i], np.round(score, 6)
                best = np.lexsort((ids[j], -score, i))
                best = best[ids[j[best]] != i[best]]
                rank = np.arange(len(best)) - np.searchsorted(i[best], i[best], side="left")
                best = best[rank < k]
                for name, values in zip(out, (i[best], ids[j[best]], score[best])):
                    out[name].append(values)
        return pa.table({n: np.concatenate(x) if x else np.empty(0, float if n == "score" else np.int64) for n, x in out.items()})

    pairs = asked.groupBy("qa", "rb").cogroup(have.groupBy("qa", "rb")).applyInArrow(product, "query_id long, neighbour_id long, score double")
    return top_per(pairs, ["query_id"], [F.desc("score"), F.col("neighbour_id")], k)


def recall_precision(got: DataFrame, gold: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, hits, n_gold, recall, precision for groups that both sides have; rows are distinct on both sides. Counts meet
    in joins, so that no group is ever gathered in one value."""
    sizes = gold.groupBy(*by).agg(F.count("*").cast("int").alias("n_gold")).join(got.groupBy(*by).agg(F.count("*").alias("n_got")), by)
    hits = got.join(gold, [*by, item], "left_semi").groupBy(*by).agg(F.count("*").cast("int").alias("hits"))
    n = F.coalesce("hits", F.lit(0))
    return sizes.join(hits, by, "left").select(*by, n.alias("hits"), "n_gold", F.round(n / F.col("n_gold"), 6).alias("recall"), F.round(n / F.col("n_got"), 6).alias("precision"))


def knn_edges(neighbours: DataFrame) -> DataFrame:
    """source, target, score: kept only where the smaller key lists the larger one."""
    return neighbours.filter("query_id < neighbour_id").select(F.col("query_id").alias("source"), F.col("neighbour_id").alias("target"), "score")


def reciprocal_rank_fusion(channels: list[tuple[str, DataFrame]], by: list[str], unit: str, k: int, constant: int = 60) -> DataFrame:
    """by, unit, rrf, methods, method (of the last channel that lists the unit), fused_rank.

    Channels are (name, rows with by, unit, rank); a unit's score sums 1 / (constant + rank). Ties go to smaller units.
    """
    parts = None
    for i, (name, rows) in enumerate(channels):
        part = rows.select(*by, unit, F.col("rank").alias("rank"), F.lit(name).alias("name"), F.lit(i).alias("ordinal"))
        parts = part if parts is None else parts.unionByName(part)
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf")
    methods = F.array_join(F.array_sort(F.collect_set("name")), ",").alias("methods")
    fused = parts.groupBy(*by, unit).agg(score, methods, F.max_by("name", "ordinal").alias("method"))
    return top_per(fused, by, [F.desc("rrf"), F.col(unit)], k, "fused_rank")


def authority_score(rank: Column, binding: Column, has_url: Column, official: Column) -> Column:
    """0 to 1 from the authority's rank and three flags; weights are fixed values."""
    clipped = F.greatest(F.lit(0), F.least(F.lit(100), rank))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return 0.5 * clipped / 100 + 0.2 * flag(binding) + 0.15 * flag(has_url) + 0.15 * flag(official)


def rerank(items: DataFrame, by: list[str], unit: str, score: str, authority: Column, temporal: Column) -> DataFrame:
    """items with final and final_rank: .75 relevance (score over the largest of its group), .2 authority, .05 temporal."""
    top = F.max(F.abs(F.col(score))).over(Window.partitionBy(*by))
    relevance = F.col(score) / F.when(top == 0, 1.0).otherwise(top)
    final = F.round(0.75 * relevance + 0.2 * authority + 0.05 * F.coalesce(temporal.cast("int"), F.lit(0)), 6)
    order = Window.partitionBy(*by).orderBy(F.desc("final"), F.col(unit))
    return items.withColumn("final", final).withColumn("final_rank", F.row_number().over(order))


def exact_lookup(units: DataFrame, refs: DataFrame, ref_key: str, coordinates: list[str], unit: str, authority: str, k: int = 5) -> DataFrame:
    """The k units that agree with a reference on every coordinate it supplies, by authority, then key.

    `coordinates` name columns of both sides, most general first; the first one must be supplied and is the join's key.
    """
    first, *rest = coordinates
    asked = refs.select(ref_key, *[F.col(c).alias("ref_" + c) for c in coordinates])
    agree = F.col(first) == F.col("ref_" + first)
    for c in rest:
        agree = agree & (F.col("ref_" + c).isNull() | (F.col(c) == F.col("ref_" + c)))
    found = asked.join(units, agree)
    return top_per(found, [ref_key], [F.desc(authority), F.col(unit)], k)


def overlap_channel(units: DataFrame, unit: str, text: str, queries: DataFrame, query: str, query_text: str, least: int = 3) -> DataFrame:
    """query, unit, overlap, score: shared distinct words of at least `least` characters over the query's words."""
    asked = queries.select(F.col(query), F.array_distinct(tokens(F.col(query_text), least)).alias("q"))
    terms = asked.select(query, F.size("q").alias("n_terms"), F.explode("q").alias("term"))
    have = units.select(F.col(unit), F.explode(F.array_distinct(tokens(F.col(text), least))).alias("term"))
    have = store(have.join(terms.select("term").distinct(), "term", "left_semi"), "postings")
    tasks = parts(have.groupBy("term").agg(F.count("*").alias("df")), terms, PAIRS)
    shared = dealt(have, unit, tasks).join(terms, "term").groupBy(query, unit, "n_terms").agg(F.count("*").alias("overlap"))
    return shared.select(query, unit, "overlap", F.round(F.col("overlap") / F.greatest(F.lit(1), F.col("n_terms")), 6).alias("score"))
