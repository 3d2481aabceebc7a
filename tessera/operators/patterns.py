"""Many fixed phrases looked for in many texts at once, by automata."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import store

#: Characters of phrases in one automaton: bounds what a worker builds and what is sent to it.
SHARD = 4 << 20


@functools.lru_cache(maxsize=2)
def _automaton(phrases: tuple[tuple[int, str], ...]) -> ahocorasick.Automaton:
    """Built once in each worker process."""
    found = ahocorasick.Automaton()
    for number, phrase in phrases:
        found.add_word(phrase, (number, len(phrase)))
    found.make_automaton()
    return found


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def matches(text: str, automaton: ahocorasick.Automaton, whole_words: bool, at_start: bool) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of every occurrence; with at_start only those where the text begins, white space aside."""
    begin = len(text) - len(text.lstrip())
    for last, (number, size) in automaton.iter(text):
        start, end = last - size + 1, last + 1
        if at_start and start != begin:
            continue
        if whole_words and (start and _inside(text[start - 1]) and _inside(text[start]) or end < len(text) and _inside(text[end]) and _inside(text[last])):
            continue
        yield number, start, end


def longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Leftmost matches that don't overlap, of those that begin together the longest; equal phrases all stay."""
    out, free = [], 0
    for number, start, end in sorted(found, key=lambda m: (m[1], -m[2], m[0])):
        if start >= free or out and (start, end) == out[-1][1:]:
            out.append((number, start, end))
            free = max(free, end)
    return out


def phrase_matches(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str, whole_words: bool = True, at_start: bool = False, only_longest: bool = True) -> DataFrame:
    """key, phrase_key, start, end (code points, end exclusive): phrases that stand in texts, case aside.

    Texts are read once for each automaton, and there is one for each SHARD of phrases, so a curated list costs one pass;
    nothing is multiplied, and texts move only where several automata need a choice between their matches. Empty and null
    phrases and texts match nothing; equal phrases under several keys match each; repeated texts give their matches each.
    Lower case is by character, so that places stay those of the text.
    """
    kind, phrase_kind = dict(texts.dtypes)[key], dict(phrases.dtypes)[phrase_key]
    lower = lambda s: s if s.isascii() and s.islower() else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    known = store(phrases.filter(F.col(phrase) != "").select(F.col(phrase_key).alias("phrase_key"), F.col(phrase).alias("phrase")).distinct().withColumn("number", F.monotonically_increasing_id()), "phrases")
    total = known.agg(F.sum(F.length("phrase"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    rows = texts.filter(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = store(rows, "phrase-texts") if shards > 1 else rows
    schema = f"key {kind}, row long, number long, start int, end int"
    found = None
    for shard in range(shards):
        # about SHARD characters, a part of the list that a worker's automaton is made of
        part = known.filter(F.pmod(F.xxhash64("number"), F.lit(shards)) == shard).select("number", "phrase").collect()
        listed = tuple((r["number"], lower(r["phrase"])) for r in part)
        heads: dict[str, list[int]] = {}
        for number, p in listed:
            heads.setdefault(p, []).append(number)
        one_each = tuple((numbers[0], p) for p, numbers in heads.items())
        same = {numbers[0]: numbers for numbers in heads.values() if len(numbers) > 1}

        def run(batches: Iterator[pa.RecordBatch], one_each=one_each, same=same) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(one_each) if one_each else None
            for batch in batches:
                out: list[tuple] = []
                for i, value in enumerate(batch.column(1).to_pylist() if automaton else ()):
                    hits = [(n, a, b) for first, a, b in matches(lower(value), automaton, whole_words, at_start) for n in same.get(first, (first,))]
                    out += [(i, *m) for m in (longest(hits) if only_longest else hits)]
                columns = list(zip(*out)) or [(), (), (), ()]
                where = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(2).take(where), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32()))]], ["key", "row", "number", "start", "end"])

        got = rows.mapInArrow(run, schema)
        found = got if found is None else found.unionByName(got)
    if shards > 1 and only_longest:
        found = _choose(found, kind)
    names = F.broadcast(known) if shards == 1 else known
    out = found.join(names, "number")
    return out.select(F.col("key").alias(key), F.col("phrase_key").cast(phrase_kind).alias(phrase_key), "start", "end")


def _choose(found: DataFrame, kind: str) -> DataFrame:
    """The longest matches of each text among those of all automata."""

    def run(table: pa.Table) -> pa.Table:
        got = longest(list(zip(*(table[c].to_pylist() for c in ("number", "start", "end")))))
        numbers, starts, ends = zip(*got)
        first = [table["key"][0].as_py()] * len(got), [table["row"][0].as_py()] * len(got)
        return pa.table([pa.array(first[0], table.schema.field("key").type), pa.array(first[1], pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "row", "number", "start", "end"])

    return found.groupBy("row").applyInArrow(run, f"key {kind}, row long, number long, start int, end int").select("key", "row", "number", "start", "end")
