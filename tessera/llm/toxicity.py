"""Toxicity by a classifier chain.

Categories are predicted one after the other; each one's linear model sees the text's features and the probabilities of
the categories before it. In training those are out-of-fold: a row's own label never helped to make the probability
that a later model learns from, nor to choose that model's features. Labels know two categories, low quality and toxic, so
the chain has these two. Features are the presence of lower-cased words and of their beginnings, as far as they go with a
category; the chosen lists are of fixed size, so scoring is one pass without any exchange of rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: In the chain's order; the last one decides.
CATEGORIES = ("low_quality", "toxic")
PREFIXES = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """`=word` and `word-beginning` of a text, of whatever length the text is."""
    words = set(_WORD.findall((text or "").lower()))
    out = {"=" + w for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) > n)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 20) -> np.ndarray:
    """Logistic regression with an L2 penalty by Newton's method; the last weight is the intercept (hardly penalised)."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class ChainModel:
    """Chosen features and one weight vector per category."""

    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)))
        known = self.vocabulary
        for i, text in enumerate(texts):
            if text:
                for word in set(_WORD.findall(text.lower())):
                    at = known.get("=" + word)
                    if at is not None:
                        out[i, at] = 1
                    for n in PREFIXES:
                        if len(word) > n:
                            at = known.get(word[:n])
                            if at is not None:
                                out[i, at] = 1
        return out

    def chain(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category."""
        done: list[np.ndarray] = []
        for w in self.weights:
            done.append(_predict(w, np.column_stack([x, *done])))
        return np.column_stack(done)


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, chosen: dict[tuple, list[int]] | None = None) -> list[np.ndarray]:
    """A weight vector per column of labels; earlier columns' probabilities are out-of-fold while later ones train.

    chosen: by (column of labels, fold) the columns of x for models that never see that fold, by (column, None) those of
    the models that are returned, whose other weights are 0; all columns if not given.
    """
    weights, extra, n = [], np.empty((len(x), 0)), x.shape[1]
    for j in range(labels.shape[1]):
        y = labels[:, j]

        def seen_by(fold: int | None, j: int = j, extra: np.ndarray = extra) -> tuple[list[int], np.ndarray]:
            mine = list(range(n)) if chosen is None else chosen.get((j, fold), [])
            return mine, np.hstack((x[:, mine], extra))

        mine, z = seen_by(None)
        full = np.zeros(n + j + 1)
        full[[*mine, *range(n, n + j + 1)]] = fit_linear(z, y)
        weights.append(full)
        out = np.zeros(len(x))
        for fold in np.unique(folds):
            held, (_, z) = folds == fold, seen_by(int(fold))
            out[held] = _predict(fit_linear(z[~held], y[~held]), z[held]) if (~held).any() else y.mean()
        extra = np.column_stack((extra, out))
    return weights


def _choose(sample: DataFrame, n_folds: int, n_features: int) -> dict[tuple, list[str]]:
    """By (category, fold or None) the features that go with the category in all rows but those of the fold.

    At most n_features each: those with the largest excess over chance, ties by name. Counts are made per fold once.
    """
    counted = ["1", *[f"y{j}" for j in range(len(CATEGORIES))]]
    in_fold = [F.sum(F.expr(f"if(fold = {k}, {y}, 0)")).alias(f"s{i}_{k}") for i, y in enumerate(counted) for k in range(n_folds)]
    whole = sample.agg(*in_fold).first()
    seen = sample.select("fold", *counted[1:], F.explode("features").alias("f")).groupBy("f").agg(*in_fold)
    cases = []
    for left_out in [None, *range(n_folds)]:
        rest = [k for k in range(n_folds) if k != left_out]
        total = lambda i, of=None, rest=rest: sum((F.col(f"s{i}_{k}") for k in rest), F.lit(0)) if of is None else sum(of[f"s{i}_{k}"] or 0 for k in rest)
        for j in range(len(CATEGORIES)):
            expected = total(0) * F.lit(total(j + 1, whole) / max(1, total(0, whole)))
            gain = (total(j + 1) - expected) / F.sqrt(expected + 1)
            cases.append(F.struct(F.lit(j).alias("j"), F.lit(-1 if left_out is None else left_out).alias("fold"), F.when((total(j + 1) >= 3) & (gain >= 2.0), gain).alias("gain")))
    rows = seen.select("f", F.explode(F.array(*cases)).alias("c")).filter("c.gain is not null").select("f", "c.*")
    best = Window.partitionBy("j", "fold").orderBy(F.desc("gain"), "f")
    out: dict[tuple, list[str]] = {}
    for r in rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_features).select("j", "fold", "f").collect():
        out.setdefault((r["j"], None if r["fold"] < 0 else r["fold"]), []).append(r["f"])
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, n_features: int = 512, n_folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> ChainModel:
    """Fits the chain on at most `per_class` toxic and as many other labelled documents, chosen by a hash of the id.

    Labels: doc_id, toxic, quality (0 or 1). Rows with a null id or null toxic label don't count; of repeated labels the
    largest toxic and the least quality hold, a null quality counts as good; of documents with the same id the least text
    counts. Without labelled documents no text is toxic. What reaches the driver is bounded by the parameters.
    """
    spark = docs.sparkSession
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = one.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(one.filter("toxic <> 1").orderBy(*order).limit(per_class))
    texts = common.id_and_text(docs, id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = [zlib.crc32(str(i).encode()) % n_folds for i in batch.column(0).to_pylist()]
            found = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold, pa.int32()), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.string()))], ["doc_id", "fold", "y0", "y1", "features"])

    common.small_batches(spark)
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic", "quality").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", (1 - F.col("quality")).alias("y0"), F.col("toxic").alias("y1"))
    sample = common.materialize(rows.mapInArrow(read, "doc_id long, fold int, y0 int, y1 int, features array<string>"), "toxicity-sample")
    names = _choose(sample, n_folds, n_features)
    vocabulary = {f: i for i, f in enumerate(sorted({f for fs in names.values() for f in fs}))}
    # only numbers come back, as Arrow columns: a row per sampled document
    known = sample.sparkSession.createDataFrame(list(vocabulary.items()), "f string, at int")
    pairs = sample.select("doc_id", F.explode("features").alias("f")).join(F.broadcast(known), "f").groupBy("doc_id").agg(F.collect_list("at").alias("f"))
    kept = sample.select("doc_id", "fold", "y0", "y1").join(pairs, "doc_id", "left").toArrow().combine_chunks().sort_by("doc_id")
    common.discard(sample)
    if not kept.num_rows:
        return ChainModel({}, [np.array([*[0.0] * j, -30.0]) for j in range(len(CATEGORIES))])
    x, found = np.zeros((kept.num_rows, len(vocabulary)), np.uint8), kept["f"].combine_chunks()
    x[np.repeat(np.arange(kept.num_rows), found.value_lengths().fill_null(0).to_numpy()), found.flatten().to_numpy()] = 1
    y, folds = np.column_stack([kept[c].to_numpy() for c in ("y0", "y1")]).astype(float), kept["fold"].to_numpy()
    weights = fit_chain(x, y, folds, {k: sorted(vocabulary[f] for f in fs) for k, fs in names.items()})
    used = sorted({vocabulary[f] for j in range(len(CATEGORIES)) for f in names.get((j, None), [])})
    mine = {at: i for i, at in enumerate(used)}
    return ChainModel({f: mine[at] for f, at in vocabulary.items() if at in mine}, [np.concatenate((w[used], w[len(vocabulary) :])) for w in weights])


def toxicity(df: DataFrame, model: ChainModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, toxic for every row.

    Null and empty texts have no features; a null id stays null; repeated rows each give a row; an empty table gives an
    empty result; other columns are ignored. Whole texts are read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p = model.chain(model.rows(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, j]) for j in range(len(CATEGORIES))], pa.array(p[:, -1] >= threshold)], ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def keep_clean(df: DataFrame, model: ChainModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df that aren't toxic, with df's columns."""
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.filter(pa.array(model.chain(model.rows(part.column(at).to_pylist()))[:, -1] < threshold))

    common.small_batches(df.sparkSession)
    return df.mapInArrow(keep, df.schema)
