"""Quality by weak supervision, in DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0), which says nothing. They are rules of thumb: many a good document draws a bad
vote of one of them. Documents with the same votes are alike, so expectation-maximisation runs over the table of vote
patterns (at most 3 to the number of rules rows, whatever the corpus): it estimates the share of good documents and each
rule's chance of a good vote among good and among bad documents. It starts from the share of good votes that a document
gets, which also says which class is the good one. A document stays if its posterior probability of being good reaches
the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WORD_CLASS

RULES = ("length", "word_size", "symbols", "plain_words", "sentences", "dup_lines", "repeats", "capitals", "shouting", "variety")
#: The prior weighs as much as so many documents: for the share of good ones, and for a rule's good votes in either class.
PSEUDO_DOCUMENTS = 5
PRIOR_GOOD, PRIOR_VOTES = 0.8, {"good": 0.95, "bad": 0.5}
_EDGE, _NOT_EDGE = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
#: A word of letters, with quotes or brackets before it and punctuation behind it.
_PLAIN = _EDGE + r"[\"'(«„“]*+\p{L}++(?:['’-]\p{L}++)*+[.,;:!?)\"'»”]*+" + _NOT_EDGE
_SENTENCE_END = r"[.!?。！？]" + _NOT_EDGE
_T = "__q_text"


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`."""
    return F.transform(F.array(value), body)[0]


def _repeat_words() -> Column:
    """Words within five-word windows that occur twice or more in the text. Windows are told apart by 64-bit hashes."""
    hashes = F.col("__q_hashes")

    def covered(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        at = F.filter(F.transform(s, lambda x, i: F.when(same(x, i), x["i"]).otherwise(F.lit(-1))), lambda p: p >= 0)
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2, p + 3, p + 4)))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(ordered, covered)).otherwise(F.lit(0)).cast("long")


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and the columns __q_<feature> of each text; a null text has no words."""
    text, words = F.col(_T), F.col("__q_words")
    out = df.withColumn(_T, F.coalesce(common.column(text_col), F.lit("")))
    out = out.withColumn("__q_words", F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0)))
    out = out.withColumn("__q_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)))
    windows = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("__q_hashes", windows)
    out = out.withColumns(
        {
            "__q_n_words": F.size(words).cast("long"),
            "__q_word_chars": F.length(F.array_join(words, "")).cast("long"),
            "__q_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
            "__q_n_lines": F.size("__q_lines").cast("long"),
            "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            "__q_n_repeat_words": _repeat_words(),
            "__q_n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
            "__q_n_exclaim": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
            "__q_n_distinct": F.size(F.array_distinct(words)).cast("long"),
            "__q_n_plain": F.regexp_count(text, F.lit(_PLAIN)).cast("long"),
            "__q_n_ends": F.regexp_count(text, F.lit(_SENTENCE_END)).cast("long"),
        }
    )
    return out.drop(_T, "__q_words", "__q_lines", "__q_hashes")


def base_failed() -> Column:
    n = F.col("__q_n_words")
    return (n < 10) | (100 * F.col("__q_n_repeat_words") > 20 * n)


def votes() -> dict[str, Column]:
    """Each rule's vote from the feature columns."""
    n, chars = F.col("__q_n_words"), F.col("__q_word_chars")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    symbols, plain, ends, upper = (F.col(f"__q_n_{c}") for c in ("symbols", "plain", "ends", "upper"))
    repeats, exclaim, distinct, dup = (F.col(f"__q_n_{c}") for c in ("repeat_words", "exclaim", "distinct", "dup_lines"))
    return {
        "length": rule(n < 30, n >= 50),
        "word_size": rule((5 * chars < 22 * n) | (chars > 7 * n), (10 * chars).between(46 * n, 60 * n)),
        "symbols": rule(5 * symbols > n, 100 * symbols <= n),
        "plain_words": rule(10 * plain < 8 * n, 20 * plain >= 19 * n),
        "sentences": rule((n >= 50) & ((100 * ends < 3 * n) | (10 * ends > 4 * n)), (100 * ends >= 5 * n) & (5 * ends <= n)),
        "dup_lines": rule(dup > 0, dup == 0),
        "repeats": rule(20 * repeats > n, 100 * repeats <= n),
        "capitals": rule(20 * upper > chars, 100 * upper <= 3 * chars),
        "shouting": rule(10 * exclaim > n, 100 * exclaim <= n),
        "variety": rule(2 * distinct < n, 10 * distinct >= 6 * n),
    }


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"__q_vote_{name}": vote for name, vote in votes().items()})


def _log_odds(model: dict) -> Column:
    total = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for rule in RULES:
        good, bad = model["good"][rule], model["bad"][rule]
        vote = F.col(f"__q_vote_{rule}")
        total = total + F.when(vote == 1, math.log(good) - math.log(bad)).when(vote == -1, math.log(1 - good) - math.log(1 - bad)).otherwise(0.0)
    return total


def posterior(model: dict) -> Column:
    """Probability that a document with these votes is good."""
    return 1 / (1 + F.exp(-_log_odds(model)))


def start_model() -> dict:
    """The prior alone: share of good documents, and by class each rule's chance of voting good where it votes."""
    return {"prior": PRIOR_GOOD, **{side: dict.fromkeys(RULES, p) for side, p in PRIOR_VOTES.items()}}


def _majority(votes: Column | None = None) -> Column:
    """Share of good ones among the votes of a document, a half without votes."""
    votes = F.array(*[F.col(f"__q_vote_{r}") for r in RULES]) if votes is None else votes
    good, all_ = F.size(F.filter(votes, lambda v: v == 1)), F.size(F.filter(votes, lambda v: v != 0))
    return F.when(all_ > 0, good / all_).otherwise(F.lit(0.5))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def _chance(state: Column, votes: Column) -> Column:
    """Probability that a document with these votes is good, by a state's prior and chances."""
    weights = F.zip_with(state["good"], state["bad"], lambda g, b: F.struct((F.log(g) - F.log(b)).alias("plus"), (F.log(1 - g) - F.log(1 - b)).alias("minus")))
    return _let(weights, lambda w: 1 / (1 + F.exp(-(F.log(state["prior"]) - F.log(1 - state["prior"]) + _sum(F.zip_with(votes, w, lambda v, x: F.when(v == 1, x["plus"]).when(v == -1, x["minus"]).otherwise(F.lit(0.0))), lambda x: x)))))


def estimate(voted: DataFrame, rounds: int = 60, tolerance: float = 1e-6) -> dict:
    """Expectation-maximisation over the vote patterns of a table, from the majority's verdict on.

    An empty table leaves the start model. One aggregation counts the patterns, whose number has a bound (3 to the number of
    rules); all rounds are one expression over the array that holds them, and so one job. A round's chances come from the
    patterns weighed by the round before; it ends where the prior settles.
    """
    names = [f"__q_vote_{r}" for r in RULES]
    patterns = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    held = patterns.agg(F.array_sort(F.collect_list(F.struct(F.array(*names).alias("v"), "n"))).alias("p"), F.sum("n").alias("n"))

    def next_state(weighed: Column, before: Column) -> Column:
        """weighed: v, n and g, the share of n that is good."""
        sides = {"good": lambda x: x["g"], "bad": lambda x: x["n"] - x["g"]}

        def chances(side: str) -> Column:
            prior = PSEUDO_DOCUMENTS * PRIOR_VOTES[side]
            count = lambda i, vote: _sum(weighed, lambda x: F.when(x["v"][i] == vote, sides[side](x)).otherwise(F.lit(0.0)))
            one = lambda i: _let(F.struct(count(i, 1).alias("plus"), count(i, -1).alias("minus")), lambda c: (c["plus"] + prior) / (c["plus"] + c["minus"] + PSEUDO_DOCUMENTS))
            return F.array(*[one(i) for i in range(len(RULES))])

        share = (_sum(weighed, lambda x: x["g"]) + PSEUDO_DOCUMENTS * PRIOR_GOOD) / (F.col("n") + PSEUDO_DOCUMENTS)
        return _let(share, lambda p: F.struct(p.alias("prior"), chances("good").alias("good"), chances("bad").alias("bad"), (F.abs(p - before) < tolerance).alias("done")))

    def weighed(chance) -> Column:
        return F.transform("p", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (chance(x["v"]) * x["n"]).alias("g")))

    first = _let(weighed(_majority), lambda w: next_state(w, F.lit(-1.0)))
    step = lambda s, _: F.when(s["done"], s).otherwise(_let(weighed(lambda v: _chance(s, v)), lambda w: next_state(w, s["prior"])))
    row = held.select("n", F.aggregate(F.sequence(F.lit(2), F.lit(max(rounds, 2))), first, step).alias("s")).first()
    if not row["n"]:
        return start_model()
    return {"prior": row["s"]["prior"], **{side: dict(zip(RULES, row["s"][side])) for side in PRIOR_VOTES}}


def accuracies(model: dict) -> dict[str, float]:
    """Each rule's chance of being right where it votes."""
    p = model["prior"]
    return {r: p * model["good"][r] + (1 - p) * (1 - model["bad"][r]) for r in RULES}


def quality(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept for every row.

    Null and empty texts have no words and fail the base rules. A null id stays null; repeated rows each give a row
    (and vote again); an empty table gives an empty result; other columns are ignored.
    """
    texts = common.id_and_text(df, id_col, text_col)
    scored = common.materialize(with_votes(with_features(texts).drop("text")), "quality")
    model = estimate(scored)
    base = [F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = scored.select("doc_id", *base, base_failed().alias("base_failed"), posterior(model).alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(df: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df whose texts are kept, with df's columns, whatever their names."""
    rows, (text,) = common.placed(df, text_col)
    scored = common.materialize(with_votes(with_features(rows, text)), "quality-stage")
    model = estimate(scored)
    return common.named_as(scored.filter(~base_failed() & (posterior(model) >= threshold)), df)
