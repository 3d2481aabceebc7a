"""A hidden Markov language model over a corpus of any vocabulary.

Tokens are words and one end per text. Each token has a class: the end and the most frequent words have their own (one
for every 16 distinct words of the corpus, within bounds), all other words fall into classes by their last three bytes.
Hidden states emit classes, a class emits its words by their
smoothed share of its training counts:

    P(text) = sum over state paths of prod P(state | state before) P(class | state) * prod P(word | class).

Word counts are summed over all partitions. Frequent words (a fixed number at most) go to every worker; all others meet
their counts in a join. Baum-Welch counts of all partitions are summed by state and class, and every model comes of the
counts of every training text, whole: texts too long for one step of work are walked through in pieces that hand on their
states. The first round counts all texts, each later one counts a share of them anew and keeps the other shares' counts
(incremental EM, Neal and Hinton 1998). Texts are laid out side by side once, in stored blocks by share.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SMOOTH = 0.1
HEAD_WORDS = 1 << 18
TAILS = 2048  # classes 1 to TAILS are of words without a class of their own; class 0 is the end
OWN, OWN_MOST, WORDS_PER_OWN = 2047, 1 << 15, 16  # words with a class of their own: at least, at most, else a share
CLASSES = 1 + TAILS + OWN  # at least
STATES = 8
SLOW = 2  # training ends where held-out texts gain no more, but for the first rounds: states start nearly alike and need some to part
SHARES = 4  # of the training texts, by their words, counted anew in turn
STEP = 1.8  # of the way to a round's estimate, by logarithms; below 2 this keeps the fixed points of EM and their pull
HELD_OUT = -1  # stands for the held-out texts among the shares
ROUNDS, SETTLED = 30, 1e-4  # at most; also ended where no chance moves by more than SETTLED
BATCH_TOKENS = 800_000  # tokens that are worked on side by side
BUFFER_TOKENS = 4_000_000  # tokens that are held to bring texts of like length together
MOVES = 4096  # moves that are added up in short numbers
RESCALE = 8  # steps between two normalisations of a recursion


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def held_out(doc_id) -> bool:
    """Whether a text is kept from training; a null id counts as an empty string and so is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tail_class(word: bytes) -> int:
    return 1 + zlib.crc32(word[-3:]) % TAILS


@dataclass
class Vocabulary:
    """Training counts: the table of all words stays in the cluster; frequent words are here."""

    counts: DataFrame  # word binary, c long
    total: int  # tokens
    distinct: int
    ends: int
    index: dict[bytes, int]
    own_class: np.ndarray  # by index
    log_count: np.ndarray  # by index: log10(c + 0.1)
    log_class: np.ndarray  # by class: log10 of its smoothed total
    class_total: np.ndarray


def count_words(texts: DataFrame) -> Vocabulary:
    """Counts over the training texts of (doc_id, text)."""
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(doc_id):
                    held.update(words_of(text))
                    held[None] += 1
                    if len(held) > 200_000:
                        yield rows()
                        held.clear()
        yield rows()

    counts = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = common.materialize(counts, "word-counts")
    words = counts.filter("word is not null")
    ends = counts.filter("word is null").agg(F.sum("c").alias("c")).first()["c"] or 0
    size = F.floor(F.log2("c")).cast("int")
    by_size = {r["b"]: (r["k"], r["c"]) for r in words.groupBy(size.alias("b")).agg(F.count("*").alias("k"), F.sum("c").alias("c")).collect()}
    n_words, total = sum(k for k, _ in by_size.values()), sum(c for _, c in by_size.values())
    least, room = 64, HEAD_WORDS
    while least > 0 and by_size.get(least - 1, (0, 0))[0] <= room:
        least -= 1
        room -= by_size.get(least, (0, 0))[0]
    head = sorted(((r["c"], bytes(r["word"])) for r in words.filter(size >= least).collect()), key=lambda x: (-x[0], x[1]))
    n_own = min(len(head), max(OWN, min(n_words // WORDS_PER_OWN, OWN_MOST)))
    sums, kinds = np.zeros(max(CLASSES, 1 + TAILS + n_own)), np.zeros(max(CLASSES, 1 + TAILS + n_own))
    for r in words.groupBy(F.expr(f"cast(pmod(crc32(substring(word, -3, 3)), {TAILS}L) as int)").alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        sums[1 + r["t"]], kinds[1 + r["t"]] = r["c"], r["k"]
    own = np.array([tail_class(w) for _, w in head], np.int64)
    for i, (c, _) in enumerate(head[:n_own]):
        sums[own[i]] -= c
        kinds[own[i]] -= 1
        own[i] = 1 + TAILS + i
        sums[own[i]], kinds[own[i]] = c, 1
    sums[0], kinds[0] = ends, int(ends > 0)
    log_class = np.log10(sums + SMOOTH * (kinds + 1))
    return Vocabulary(words, int(total + ends), int(n_words + (ends > 0)), int(ends), {w: i for i, (_, w) in enumerate(head)}, own, np.log10(np.array([c for c, _ in head], float) + SMOOTH), log_class, sums)


CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_sum double, log_classes double, classes binary, rest array<binary>"


def encode(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every text as its classes (16-bit), sums over its frequent words, and the list of its other words."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary.index, vocabulary.own_class, vocabulary.log_count, vocabulary.log_class, vocabulary.ends))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own, log_count, log_class, ends = sent.value
        log_end, names = math.log10(ends + SMOOTH), [x.split()[0] for x in CODED.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                words = [words_of(text) for text in part.column(1).to_pylist()]
                n = np.array([len(x) for x in words], np.int64)
                ends_at = np.cumsum(n + 1)
                begins = ends_at - n - 1
                every = list(chain.from_iterable(words))
                where = np.fromiter(map(index.get, every, repeat(-1)), np.int64, len(every))
                known = where >= 0
                at = np.arange(len(every)) + np.repeat(np.arange(len(words)), n)  # a place behind each text is its end's
                classes, logs, hits = np.zeros(len(every) + len(words), "<u2"), np.zeros(len(every) + len(words)), np.zeros(len(every) + len(words), np.int64)
                rest = [every[i] for i in np.flatnonzero(~known)]
                classes[at[known]] = own[where[known]]
                classes[at[~known]] = [tail_class(w) for w in rest]
                logs[at[known]] = log_count[where[known]]
                hits[at] = known
                sums = [np.add.reduceat(x, begins) if len(begins) else x for x in (hits, logs, log_class[classes])]
                rests = np.cumsum(n - sums[0]).tolist()
                out = [
                    [held_out(doc_id) for doc_id in ids], n + 1, sums[0] + (ends > 0), sums[1] + log_end, sums[2],
                    [classes[a:b].tobytes() for a, b in zip(begins, ends_at)], [rest[a:b] for a, b in zip([0, *rests], rests)],
                ]
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names)

    return common.materialize(texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(code, CODED), "coded-texts")


@dataclass
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # state, next state
    emit: np.ndarray  # class, state


def first_model(class_total: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    """The classes' shares, perturbed per state; states tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (class_total + 1)[:, None] * np.exp(rng.normal(0, 0.7, (len(class_total), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _side_by_side(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token positions in time-major order, longest text first: (order of texts, tokens in that layout, texts that still
    run at each time)."""
    sizes = np.array([len(x) for x in texts])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    starts = np.cumsum(sizes) - sizes
    joined = np.concatenate([texts[i] for i in order])
    offsets = np.cumsum(running) - running
    time = np.repeat(np.arange(sizes[0]), running)
    who = np.arange(len(joined)) - np.repeat(offsets, running)
    return order, joined[starts[who] + time], running


def log_likelihoods(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """ln P(classes) of each text by the scaled forward recursion, many texts at a time."""
    order, tokens, running = _side_by_side(texts)
    out = np.empty(len(texts))
    out[order] = _log_likelihoods(model, tokens, running)
    return out


def _log_likelihoods(model: Hmm, tokens: np.ndarray, running: np.ndarray) -> np.ndarray:
    """The same of texts side by side, longest first."""
    running = running.tolist()
    total, at, ones = np.zeros(running[0]), running[0], np.ones((len(model.start), 1))
    now = model.start * model.emit[tokens[:at]]
    for t, n in enumerate(running[1:], 1):
        if n < len(now):
            total[n : len(now)] += np.log(now[n:].sum(axis=1))
            now = now[:n]
        if t % RESCALE == 0:
            scale = now @ ones
            total[:n] += np.log(scale[:, 0])
            now = now / scale
        now = now @ model.move
        now *= model.emit[tokens[at : at + n]]
        at += n
    total[: len(now)] += np.log(now.sum(axis=1))
    return total


class _Room:
    """Arrays that are used again from block to block: fresh memory would cost more than the sums."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, name: str, rows: int, columns: int, kind: type) -> np.ndarray:
        if self.held.get((name, kind), np.empty(0)).size < rows * columns:
            self.held[name, kind] = np.empty(rows * columns, kind)
        return self.held[name, kind][: rows * columns].reshape(rows, columns)


def _block_counts(model: Hmm, tokens: np.ndarray, running: np.ndarray, first: np.ndarray | None, last: np.ndarray | None, room: _Room, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of starts, moves and emissions (state, class) of texts side by side, in numbers of that kind. Emissions are
    divided by the largest of their class, and every RESCALE steps a text's by its forward sum; backward states begin with one
    over the text's whole chance. So both recursions stay in range and their products are the posteriors."""
    states, n, n_texts = len(model.start), len(tokens), int(running[0])
    tokens, ones, move = tokens.astype(np.intp), np.ones((states, 1), kind), model.move.astype(kind)
    share = (model.emit / np.maximum(model.emit.max(axis=1, keepdims=True), 1e-300)).astype(kind)
    emitted = np.take(share, tokens, axis=0, out=room("emitted", n, states, kind), mode="clip")
    forward, backward = room("forward", n, states, kind), room("backward", n, states, kind)
    ends = np.cumsum(running)
    begins = ends - running
    sizes = np.searchsorted(-running, -np.arange(n_texts), side="left")
    final = begins[sizes - 1] + np.arange(n_texts)  # each text's last token
    begins, ends, running = begins.tolist(), ends.tolist(), running.tolist()
    now = forward[:n_texts]
    now[:] = model.start * emitted[:n_texts] if first is None else first / first.sum()
    for t in range(1, len(running)):
        now, scaled = now[: running[t]], emitted[begins[t] : ends[t]]
        if t % RESCALE == 0:
            scaled /= np.dot(now, ones)
        here = forward[begins[t] : ends[t]]
        np.dot(now, move, out=here)
        here *= scaled
        now = here
    last = np.ones((1, states), kind) if last is None else (last / last.sum()).astype(kind).reshape(1, -1)
    backward[final] = last / (forward[final] * last).sum(axis=1, keepdims=True)
    back, moves = np.ascontiguousarray(move.T), np.zeros((states, states))
    for t in range(len(running) - 1, 0, -1):
        after = emitted[begins[t] : ends[t]]
        after *= backward[begins[t] : ends[t]]
        np.dot(after, back, out=backward[begins[t - 1] : begins[t - 1] + running[t]])
    before = np.arange(n_texts, n) - np.repeat(running[:-1], running[1:])  # the place of each later token's text a time earlier
    for at in range(0, n - n_texts, MOVES):
        moves += np.dot(forward[before[at : at + MOVES]].T, emitted[n_texts + at : n_texts + at + MOVES])
    np.multiply(forward, backward, out=backward)
    by_state = room("by_state", states, n, np.float64)
    by_state[:] = backward.T
    by_state /= by_state.sum(axis=0)  # in short numbers they are one but for their last digits
    begin = n_texts if first is not None else 0
    emission = np.stack([np.bincount(tokens[begin:], row[begin:], len(model.emit)) for row in by_state])
    start = np.zeros(states) if first is not None else by_state[:, :n_texts].sum(axis=1)
    return start, moves * model.move, emission


def _counts_side_by_side(model: Hmm, tokens: np.ndarray, running: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None, room: _Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_block_counts in short numbers, whose sums are right to about 1e-6; again in long ones where those leave their range."""
    room = room or _Room()
    wanted = len(tokens) - (int(running[0]) if first is not None else 0)  # each counted token has one state
    with np.errstate(all="ignore"):
        counts = _block_counts(model, tokens, running, first, last, room, np.float32)
    if not (all(np.isfinite(x).all() for x in counts) and abs(counts[2].sum() - wanted) <= 1e-4 * wanted):
        counts = _block_counts(model, tokens, running, first, last, room, np.float64)
    return counts[0], counts[1], counts[2].T


def expected_counts(model: Hmm, texts: list[np.ndarray], first: np.ndarray | None = None, last: np.ndarray | None = None, room: _Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions (class, state) of complete forward and backward recursions. With
    `first`, the first tokens are those that the piece before has counted: they hand on states and count no more."""
    return _counts_side_by_side(model, *_side_by_side(texts)[1:], first, last, room)


def expected_counts_of_long(model: Hmm, text: np.ndarray, size: int, room: _Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one text of any length, of which `size` tokens at a time are worked on. Neighbouring pieces share a
    token; a first pass finds the forward states there, the second goes back with the backward states."""
    cuts = [*range(0, len(text) - 1, size), len(text) - 1]
    firsts: list[np.ndarray | None] = [None]
    for a, b in zip(cuts[:-2], cuts[1:-1]):
        now = model.start * model.emit[text[0]] if firsts[-1] is None else firsts[-1]
        for c in text[a + 1 : b + 1]:
            now = (now @ model.move) * model.emit[c]
            now = now / now.sum()
        firsts.append(now)
    total, last = None, None
    for first, a, b in zip(reversed(firsts), reversed(cuts[:-1]), reversed(cuts[1:])):
        piece = text[a : b + 1]
        counts = expected_counts(model, [piece], first, last, room)
        total = counts if total is None else tuple(x + y for x, y in zip(total, counts))
        back = np.ones(len(model.start)) if last is None else last
        for c in piece[:0:-1]:
            back = model.move @ (model.emit[c] * back)
            back = back / back.sum()
        last = back
    return total


def _grouped(batches: Iterator[pa.RecordBatch], apart: bool = False) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(keys, class arrays) of about BATCH_TOKENS tokens from rows (key, classes); texts of like length come together,
    so that few steps have few texts. A longer text stands alone. If `apart`, so do rows of different keys."""

    def dealt(held: list) -> Iterator[tuple[list, list[np.ndarray]]]:
        held.sort(key=lambda x: -len(x[1]))
        for kind in sorted({key for key, _ in held}) if apart else [None]:
            keys, texts, n = [], [], 0
            for key, classes in held:
                if apart and key != kind:
                    continue
                if n and n + len(classes) > BATCH_TOKENS:
                    yield keys, texts
                    keys, texts, n = [], [], 0
                keys.append(key)
                texts.append(classes)
                n += len(classes)
            if texts:
                yield keys, texts

    held, n = [], 0
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((key, np.frombuffer(data, "<u2")))
            n += len(held[-1][1])
            if n >= BUFFER_TOKENS:
                yield from dealt(held)
                held, n = [], 0
    yield from dealt(held)


def _no_counts(model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)


def _add_counts(total: tuple[np.ndarray, np.ndarray, np.ndarray], model: Hmm, tokens: np.ndarray, running: np.ndarray, room: _Room) -> None:
    """Adds the Baum-Welch counts of a block (tokens side by side, texts that still run at each time)."""
    long = running[0] == 1 and len(tokens) > BATCH_TOKENS
    for mine, more in zip(total, expected_counts_of_long(model, tokens, BATCH_TOKENS, room) if long else _counts_side_by_side(model, tokens, running, room=room)):
        mine += more


def counts_of(model: Hmm, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of all rows (key, classes)."""
    total, room = _no_counts(model), _Room()
    for _, texts in _grouped(batches):
        _add_counts(total, model, *_side_by_side(texts)[1:], room)
    return total


def laid_out(coded: DataFrame) -> DataFrame:
    """held_out, tokens, running, share: the texts in stored blocks side by side, held-out ones and each share of the others
    apart. A text's share depends on its words alone, so not on the order of rows; copies are spread over the tasks."""
    spark = coded.sparkSession
    share = F.when(F.col("held_out"), HELD_OUT).otherwise(F.pmod(F.xxhash64("classes"), F.lit(SHARES))).cast("int")
    tokens = coded.agg(F.sum(F.octet_length("classes"))).first()[0] or 0
    tasks = max(1, -(-tokens // 2 // BUFFER_TOKENS))
    part = F.pmod(F.xxhash64("row"), F.lit(-(-tasks // SHARES)))
    texts = coded.select(share.alias("share"), "classes", part.alias("part")).repartition(tasks, "share", "part").drop("part")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _grouped(batches, apart=True):
            _, tokens, running = _side_by_side(texts)
            columns = [[keys[0] == HELD_OUT], [tokens.tobytes()], [running.astype("<i4").tobytes()], keys[:1]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.bool_(), pa.binary(), pa.binary(), pa.int32()))], ["held_out", "tokens", "running", "share"])

    blocks, path = texts.mapInArrow(lay, "held_out boolean, tokens binary, running binary, share int"), common.scratch_path(spark, "blocks")
    blocks.write.partitionBy("share").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def train(coded: DataFrame, class_total: np.ndarray) -> Hmm:
    """Baum-Welch over the coded training texts; only sums by (share, state, class) and (share, state, state) leave the
    partitions. A round counts a share anew by the model it begins with, the first round all of them; the next model is made
    of the last counts of all shares.

    Each round also scores the held-out texts by the model it begins with, in the same pass. They teach it nothing but when
    to stop: once a turn of all shares has brought no gain. The model that was best on them is kept. Small gains end nothing.
    """
    model, best, known, since = first_model(class_total), None, None, 0
    spark, by_state, blocks = coded.sparkSession, [f"n{j}" for j in range(STATES)], laid_out(coded)
    counts: dict[int, tuple] = {}  # the last ones of each share
    models = [model]
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, room, totals = sent.value, _Room(), {}
            score = np.zeros((2, STATES))  # sum of log10 and tokens, in the first column
            for batch in batches:
                for held, *block, share in zip(*[batch.column(i) for i in range(4)]):
                    tokens, running = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(block, ("<u2", "<i4")))
                    if held.as_py():
                        score[:, 0] += _log_likelihoods(model, tokens, running).sum() / math.log(10), len(tokens)
                    else:
                        _add_counts(totals.setdefault(share.as_py(), _no_counts(model)), model, tokens, running, room)
            for share, tables in [*totals.items(), (HELD_OUT, [score])]:
                for kind, table in enumerate(tables):
                    table = np.atleast_2d(table)
                    at = np.flatnonzero(table.any(axis=1))
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(at), x, np.int32)) for x in (share, kind)], pa.array(at.astype(np.int32)), *[pa.array(column) for column in table[at].T]], ["share", "kind", "i", *by_state])

        # with no share counted yet, all are
        asked = blocks.filter(F.col("share").isin(HELD_OUT, sorted(counts)[(turn - 1) % len(counts)])) if counts else blocks
        sums = asked.mapInArrow(count, "share int, kind int, i int, " + ", ".join(f"{n} double" for n in by_state)).groupBy("share", "kind", "i").agg(*[F.sum(n).alias(n) for n in by_state])
        sums = sums.select("share", "kind", "i", *by_state).toArrow().to_pandas()
        held = dict(zip(*[sums.loc[sums["share"] == HELD_OUT, c].tolist() for c in ("i", "n0")]))
        for share, rows in sums[sums["share"] != HELD_OUT].groupby("share"):
            counts[int(share)] = tables = _no_counts(model)
            for kind, table in enumerate(tables):
                mine = rows[rows["kind"] == kind]
                np.atleast_2d(table)[mine["i"].to_numpy()] = mine[by_state].to_numpy()
        if not counts:
            break
        if held.get(1):
            now = held.get(0, 0.0) / held[1]
            best, known, since = (model, now, 0) if known is None or now > known or turn < SLOW else (best, known, since + 1)
            if since >= len(counts):
                return best
        estimate = _reestimate(model, [{"kind": kind, "i": i, "n": n} for kind, tables in enumerate(zip(*counts.values())) for i, n in enumerate(np.atleast_2d(sum(tables)))], class_total)
        model = _further(model, estimate) if turn else estimate
        models = [*models[-len(counts) :], model]
        if len(models) > len(counts) and max(np.abs(a - b).max() for a, b in ((models[0].start, model.start), (models[0].move, model.move), (models[0].emit, model.emit))) < SETTLED:
            break
    return best if since else model


def _reestimate(model: Hmm, sums: list, class_total: np.ndarray) -> Hmm:
    """Shares of the counts, rows (kind, i, n by state). Each state's emissions are smoothed by one count spread like the
    corpus."""
    tables = [np.full((1, len(model.start)), 0.01), np.full_like(model.move, 0.01), np.zeros_like(model.emit)]
    prior = (class_total + SMOOTH) / (class_total + SMOOTH).sum()
    tables[2] += prior[:, None]
    for r in sums:
        tables[r["kind"]][r["i"]] += r["n"]
    start, move, emit = tables
    return Hmm(start[0] / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _further(model: Hmm, estimate: Hmm) -> Hmm:
    """STEP times the way from the model to its new estimate."""
    ways = []
    for a, b, axis in ((model.start, estimate.start, 0), (model.move, estimate.move, 1), (model.emit, estimate.emit, 0)):
        x = np.exp((1 - STEP) * np.log(np.maximum(a, 1e-300)) + STEP * np.log(np.maximum(b, 1e-300)))
        ways.append(x / x.sum(axis=axis, keepdims=True))
    return Hmm(*ways)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; scores are log10.

    Null and empty texts hold the end alone; a null id stays null and is held out; repeated rows each count and each
    give a row; an empty table gives an empty result; other columns are ignored. Whole texts are scored.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    texts = common.id_and_text(df, id_col, text_col)
    vocabulary = count_words(texts)
    coded = encode(texts, vocabulary)
    model = train(coded, vocabulary.class_total)
    sent = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _grouped(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(log_likelihoods(sent.value, part) / math.log(10))], ["row", "forward"])

    rest = coded.select("row", F.explode("rest").alias("word")).join(vocabulary.counts, "word", "left")
    seen = F.coalesce(F.col("c"), F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.log10(seen + SMOOTH)).alias("rest_sum"), F.sum((seen > 0).cast("long")).alias("rest_known"))
    paths = coded.select("row", "classes").mapInArrow(forward, "row long, forward double")
    out = coded.drop("classes", "rest").join(paths, "row").join(rest, "row", "left")
    log_sum = F.col("log_sum") + F.coalesce("rest_sum", F.lit(0.0))
    per_token = math.log10(vocabulary.total + SMOOTH * (vocabulary.distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (log_sum - F.col("n_tokens") * per_token).alias("base_score"), (F.col("forward") + log_sum - F.col("log_classes")).alias("score"))
