"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in the prefix's encoding. Storing that token per
prefix gives the encoding of every prefix, so an append only extends the table, and an edit only recomputes the
pieces around it. Whether token b may follow token a is decided from the two tokens alone: undo both tokens' merges
from the latest on, and look for a merge across the seam that would have come first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .vocab import rank_table


class PrefixBpe:
    """Encoder and decoder over a table of ranks. Text is cut by `pattern`; each piece is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 200_000):
        import ahocorasick
        import regex

        self.ranks, self.cache_size = ranks, cache_size
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = regex.compile(pattern).findall
        self.split_regex = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = self._split(token, rank)
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.halves[rank][0] >= 0:
                self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self._follows: dict[tuple[int, int], bool] = {}
        self._joined: dict[str, str] = {}
        self._joined_before: dict[str, str] = {}

    def _split(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own half."""
        if len(token) == 1:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best[0] >= rank:  # not reachable by merges: never a result of encoding
                return -1, -1
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _check(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens. Runs time backwards. `bound`: the rank of the merge that was undone last; a merge across the seam that ranks
        before it (ties to the left) would have happened first and so rules the pair out."""
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        if halves[left][0] < 0 or halves[right][0] < 0:
            return False
        bound = len(ranks) + 1
        while True:
            seam = ranks.get(tokens[left] + tokens[right])
            if seam is not None and seam < bound:
                return False
            left_half, right_half = halves[left][1], halves[right][0]
            if left > right and left_half != left or right_half == right and left_half != left:
                bound, left = left, left_half
            elif right_half != right:
                bound, right = right + 1, right_half
            else:
                return True

    def extend(self, data: bytes, last: list[int], done: int = 0) -> list[int]:
        """last[i]: the last token of data[:i + 1]. Fills the table from `done` on; earlier entries stay valid.

        An automaton over all tokens names the tokens that end at each byte, so nothing else is looked up.
        """
        del last[done:]
        known, check = self._follows, self._check
        for end, (token, size) in self.endings.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            if end != done:  # this prefix has its token already
                continue
            if size > end:
                fits = True
            else:
                pair = (last[end - size], token)
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = check(*pair)
            if fits:
                last.append(token)
                done += 1
        if done < len(data):
            raise ValueError("the rank table lacks a byte")
        if len(known) > 4 * self.cache_size:
            known.clear()
        return last

    def walk(self, last: list[int], size: int) -> list[int]:
        """The encoding of the first `size` bytes, read off the table backwards."""
        out = []
        while size:
            token = last[size - 1]
            out.append(token)
            size -= len(self.tokens[token])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        return self.walk(self.extend(data, []), len(data))

    def encode(self, text: str) -> list[int]:
        joined = self.joined_ids(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def joined_ids(self, text: str) -> str:
        """Decimal ids joined by commas. Pieces seen lately come from a cache of two bounded generations."""
        cache, before, out = self._joined, self._joined_before, []
        for piece in self.pieces(text):
            ids = cache.get(piece)
            if ids is None:
                ids = before.get(piece) or ",".join(map(str, self.encode_piece(piece)))
                if len(piece) <= 40:
                    if len(cache) >= self.cache_size:
                        self._joined_before = before = cache
                        self._joined = cache = {}
                    cache[piece] = ids
            out.append(ids)
        return ",".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @functools.cached_property
    def by_decimal(self) -> dict[str, bytes]:
        return {str(rank): token for rank, token in self.tokens.items()}

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, joined.split(","))) if joined else b""


class EncodedText:
    """A text with its pieces' prefix tables, for appends and edits that only touch the pieces around a change."""

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.parts: list[tuple[int, str, list[int]]] = []  # start, piece, table
        self.recomputed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Replaces text[begin:end]. Pieces well before the change stay; after it, pieces stay once a cut meets an old one.

        A piece's end can depend on what follows it, so cutting restarts one piece before the one that is touched.
        """
        text = self.text[:begin] + new + self.text[end:]
        touched = next((i for i, (at, piece, _) in enumerate(self.parts) if at + len(piece) >= begin), len(self.parts))
        first = max(0, touched - 1)
        kept = self.parts[:first]
        at = kept[-1][0] + len(kept[-1][1]) if kept else 0
        shift = len(new) - (end - begin)
        after = {start + shift: i for i, (start, _, _) in enumerate(self.parts) if start >= end}
        old = {start: (piece, table) for start, piece, table in self.parts[first : touched + 1]}
        made = []
        for match in self.bpe.split_regex.finditer(text, at):
            start = match.start()
            if start >= begin + len(new) + 1 and start in after and start - 1 >= 0:
                # one full piece beyond the change begins where an old one did: the rest is as before
                made += [(s + shift, p, t) for s, p, t in self.parts[after[start] :]]
                break
            piece = match[0]
            data = piece.encode()
            was = old.get(start)
            if was and piece.startswith(was[0]):  # appended to: the table of the old bytes stays valid
                table = self.bpe.extend(data, list(was[1]), len(was[0].encode()))
                self.recomputed += len(data) - len(was[0].encode())
            else:
                table = self.bpe.extend(data, [])
                self.recomputed += len(data)
            made.append((start, piece, table))
        self.text, self.parts = text, kept + made

    def ids(self) -> list[int]:
        return [t for _, piece, table in self.parts for t in self.bpe.walk(table, len(piece.encode()))]


@functools.lru_cache(maxsize=2)
def worker_bpe(vocab_path: str, pattern: str) -> PrefixBpe:
    return PrefixBpe(rank_table(vocab_path), pattern)


def encode_documents(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined) and decoded (the bytes the ids decode to) for every row.

    Null text counts as empty: 0 tokens, empty ids and bytes. A null id stays null, repeated rows each give a row, an
    empty table gives an empty result, other columns are ignored. Whole texts, no special tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.joined_ids(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([bpe.decode_joined(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    common.small_batches(df.sparkSession)
    return common.id_and_text(df, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded binary")
