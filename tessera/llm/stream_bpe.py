"""Byte pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

The merge list says how far ahead the end of a token can depend on what follows it (`lookahead`). A text passes through in
windows; a token leaves as soon as that many symbols stand behind it, or its word has ended. What is held is a window, the
open word's last symbols and a memo of bounded size, however long a text or a word is. Only a run of combining marks is held
whole, since its normal form needs it.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .fast_ids import byte_symbols, plain_words
from .vocab import library_tokenizer

WINDOW, MEMO_WORDS, MEMO_CHARS = 1 << 16, 1 << 17, 64
#: Symbols up to which plain search is faster than a heap; bits of an id; no merge.
SHORT, _ID, _MASK, _NONE = 24, 24, (1 << 24) - 1, 1 << 62
_SPACE = regex.compile(r"\s")
_CLEAN = re.compile(r"[\x09-\x0d ](?=[\x21-\x7e])")


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols behind a token that settle it: equal that far, two texts with equal beginnings have it in common.

    Let z be the leftmost boundary that only one of two runs has erased, by merge k = (u, v) with v = [z, q). Left of z both
    runs are equal until then, so the other run lacks v, by a boundary in (z, q] that differs already: one inside v, where a
    merge of v's own derivation stands at a known distance from z; or q, where a piece s at v's right edge was taken by an
    earlier merge (s, w) of the other run. Ranks fall along such a chain, so each merge's reach follows from those before it.
    length: symbols of a token.
    """
    reach = [0] * len(merges)
    takers: dict[str, list[tuple[int, int]]] = {}  # by left part: (rank, longest reach so far)
    made: dict[str, tuple[int, str]] = {}  # token: its merge and right part
    inside: dict[str, list[tuple[int, int]]] = {}  # token: (distance of the split, merge)
    for k, (u, v) in enumerate(merges):
        far = max([length(v), *(at + reach[j] for at, j in inside.get(v, ()))])
        edge, taken = v, k
        while True:
            rivals = takers.get(edge, [])
            before = bisect_left(rivals, (taken,))
            if before:
                far = max(far, length(v) + rivals[before - 1][1])
            if edge not in made:
                break
            taken, edge = made[edge]
        reach[k] = far
        own = takers.setdefault(u, [])
        own.append((k, max(far, own[-1][1] if own else 0)))
        if u + v not in made:
            made[u + v] = k, v
            n = length(u)
            inside[u + v] = [*inside.get(u, ()), (n, k), *((n + at, j) for at, j in inside.get(v, ()))]
    return max(reach, default=0) + 1


class Merges:
    """The merge list of a word vocabulary file: symbols are bytes, the last one of a word bears the end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        symbols = byte_symbols()
        self.open = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.ended = {vocab[c]: vocab[c + end] for c in symbols}
        #: a pair of ids as one number: its rank and what it makes as one number
        self.ranks = {vocab[a] << _ID | vocab[b]: rank << _ID | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        size = lambda token: len(token) - (len(end) if token.endswith(end) and token != end else 0)
        self.lookahead = sufficient_lookahead(pairs, size)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.width = [0] * len(self.names)
        for token, i in vocab.items():
            self.names[i], self.width[i] = token, size(token)
        for token, i in self.special.items():
            self.names[i] = token
        back = {c: b for c, b in symbols.items()}
        self.bytes = [bytes(back[c] for c in (x[: -len(end)] if x.endswith(end) else x)) + (b" " if x.endswith(end) else b"") if x not in self.special else x.encode() for x in self.names]
        self.written, self.numbers = [x.encode() for x in self.names], [str(i) for i in range(len(self.names))]
        tokens = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, tokens)) or r"(?!)")

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a run of symbols: the lowest rank first, equal ones from the left."""
        if len(ids) > SHORT:
            return self._merged_long(ids)
        find, ids = self.ranks.get, list(ids)
        made = [find(a << _ID | b, _NONE) for a, b in zip(ids, ids[1:])]
        while made:
            best = min(made)
            if best == _NONE:
                break
            i = made.index(best)
            ids[i : i + 2] = [best & _MASK]
            del made[i]
            if i:
                made[i - 1] = find(ids[i - 1] << _ID | ids[i], _NONE)
            if i < len(made):
                made[i] = find(ids[i] << _ID | ids[i + 1], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of places and a list of neighbours."""
        n, find, ids = len(ids), self.ranks.get, list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := find(a << _ID | b, _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or find(ids[i] << _ID | ids[j], _NONE) != best:
                continue
            ids[i], ids[j], after[i] = best & _MASK, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := find(ids[left] << _ID | ids[right], _NONE)) != _NONE:
                    heapq.heappush(heap, (found, left))
        return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Transducer:
    """Takes a word's bytes in any pieces; returns ids as soon as nothing that may follow can change them."""

    def __init__(self, table: Merges):
        self.table, self.held = table, []
        self.limit = 4 * table.lookahead

    def push(self, piece: bytes) -> list[int]:
        """Ids that are settled by now. One byte stays back, as the last one bears the end mark."""
        out, one = [], self.table.open
        for at in range(0, len(piece), self.limit):
            self.held += [one[b] for b in piece[at : at + self.limit]]
            if len(self.held) > self.limit:
                ids, left = self.table.merged(self.held[:-1]), len(self.held) - 1 - self.table.lookahead
                settled, used = 0, 0
                while settled < len(ids) and used + self.table.width[ids[settled]] <= left:
                    used += self.table.width[ids[settled]]
                    settled += 1
                out += ids[:settled]
                self.held = self.held[used:]
        return out

    def close(self) -> list[int]:
        """The word has ended: all that is left."""
        if not self.held:
            return []
        ids = self.table.merged([*self.held[:-1], self.table.ended[self.held[-1]]])
        self.held = []
        return ids


def _kind(c: str) -> str:
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "S" if _SPACE.match(c) else "O"


def _stable(c: str) -> bool:
    """Whether normal forms before and from this character on don't depend on each other."""
    if c < "̀":
        return True
    jamo = "ᅠ" <= c <= "ᇿ"
    return not jamo and unicodedata.category(c)[0] not in "MC" and unicodedata.is_normalized("NFC", c)


def windows(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Parts of a text that can be normalised and split into words on their own, and whether a word may go on behind.

    A part ends before a word if it can; else inside one, where no contraction starts.
    """
    at, n = 0, len(text)
    while n - at > size:
        end = at + size
        clean = max((m.end() for m in _CLEAN.finditer(text, max(at, end - 1024), end + 1)), default=0)
        if clean > at:
            yield text[at:clean], False
            at = clean
            continue
        fits = lambda i: _stable(text[i]) and text[i] != "'" and "'" not in text[i - 2 : i]
        cut = next((i for i in range(end, at + 2, -1) if fits(i)), None) or next((i for i in range(end + 1, n) if fits(i)), n)
        yield text[at:cut], cut < n
        at = cut
    if at < n:
        yield text[at:], False


class Encoder:
    """Ids of texts by a word vocabulary file, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str, window: int = WINDOW):
        self.table, self.window = merges(path), window
        self.memo: dict[str, list[int]] = {}
        self.tokenizer = library_tokenizer(path)

    def _words(self, part: str) -> tuple[list[str], bool, str]:
        """The words of a part, whether they are written in byte symbols, and the normal form (its ends matter only)."""
        known = plain_words(part)
        if known is not None:
            return known, False, part.lower()
        normal = self.tokenizer.normalizer.normalize_str(part)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)], True, normal

    def _bytes(self, word: str, symbols: bool) -> bytes:
        if not symbols:
            return word.encode()
        table = byte_symbols()
        return bytes(table[c] for c in word)

    def _whole(self, word: str, symbols: bool, key: str) -> list[int]:
        """Ids of a word that begins and ends here."""
        run = Transducer(self.table)
        ids = run.push(self._bytes(word, symbols)) + run.close()
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[key] = ids
        return ids

    def _segment(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens, block by block."""
        run, kind = Transducer(self.table), ""  # the kind of the word that is open
        for part, goes_on in windows(text, self.window):
            words, symbols, normal = self._words(part)
            out: list[int] = []
            if kind:
                if normal and words and _kind(normal[0]) == kind:
                    out += run.push(self._bytes(words[0], symbols))
                    words = words[1:]
                    if not words and goes_on and _kind(normal[-1]) == kind:
                        yield out
                        continue
                out += run.close()
                kind = ""
            last = None
            contraction = words and words[-1][0] == "'" and _kind(normal[-1]) == "L"
            if goes_on and words and not contraction and _kind(normal[-1]) in "LO":
                kind, last = _kind(normal[-1]), words[-1]
                words = words[:-1]
            memo, lead = self.memo.get, "\n" if symbols else ""
            for word in words:
                key = lead + word if symbols else word
                ids = memo(key)
                out += self._whole(word, symbols, key) if ids is None else ids
            if last is not None:
                out += run.push(self._bytes(last, symbols))
            yield out
        yield run.close()

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, block by block. Strings of special tokens in it are these tokens."""
        at = 0
        for found in self.table.split.finditer(text):
            yield from self._segment(text[at : found.start()])
            yield [self.table.special[found[0]]]
            at = found.end()
        yield from self._segment(text[at:] if at else text)


class Decoder:
    """Text of ids as they come, from their bytes: holds no more than an unfinished character."""

    def __init__(self, table: Merges, written: bool = False):
        """written: as the vocabulary writes its tokens, one space between two, as the library's decode of a file without
        a decoder; else the text itself, in the lower case and with one space after each word."""
        self.pieces = table.written if written else table.bytes
        self.between = b" " if written else b""
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.pieces.__getitem__, ids))
        if self.between and ids:
            data, self.first = data if self.first else self.between + data, False
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


def transduce(df: DataFrame, path: str, written: bool = True, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one space between two), decoded for every row, from one pass over each text.

    Null text counts as empty: no ids, an empty text. A null id stays null; repeated rows each give a row; an empty table
    gives an empty result; other columns are ignored.
    """
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, window)
        numbers = encoder.table.numbers
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                decoder, n, some, decoded = Decoder(encoder.table, written), 0, [], []
                for block in encoder.blocks(text or ""):
                    if block:
                        n += len(block)
                        some.append(" ".join(map(numbers.__getitem__, block)))
                        decoded.append(decoder.feed(block))
                counts.append(n)
                ids.append(" ".join(some))
                texts.append("".join([*decoded, decoder.end()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return common.id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
