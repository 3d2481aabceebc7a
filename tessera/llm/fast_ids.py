"""Ids that equal the tokenizers library's, computed faster where that is provably the same.

Byte-level files: the rank file of the same vocabulary gives the same ids. Word files (lower case, word ends): words
are cut here and merged by ranks, where the end-of-word mark is one byte that the text can't hold. Any text with a
character outside the range for which both ways were compared code point by code point goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from .vocab import library_tokenizer, rank_encoding, safe_chunks

#: Characters for which equality with the library was checked one by one (tests/llm/test_tokens.py).
_KNOWN = "\x02-\x1b\x20-\x7f\xa1-įı-ž‐-•…"
_UNKNOWN = re.compile(f"[^{_KNOWN}]")
#: Letters and numbers among them, after lower-casing.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_END = "\x01"
CHUNK = 1 << 16


def plain(text: str) -> bool:
    """Whether the fast way is known to equal the library for this text."""
    return "<|" not in text and _UNKNOWN.search(text) is None


def byte_level_ids(text: str, vocab_path: str, ranks_path: str | None, pattern: str) -> np.ndarray:
    """Ids of a byte-level vocabulary file. Without a rank file, or for unusual characters: the library."""
    if not text:
        return np.empty(0, np.uint32)
    if ranks_path and plain(text):
        encoding = rank_encoding(ranks_path, pattern)
        parts = [encoding.encode_to_numpy(x, disallowed_special=()) for x in safe_chunks(text, CHUNK)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)
    return library_ids(text, vocab_path)


def library_ids(text: str, vocab_path: str) -> np.ndarray:
    return np.array(library_tokenizer(vocab_path).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The public rule for writing bytes as characters: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _word_encoding(vocab_path: str):
    import tiktoken

    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = byte_symbols(), {x["content"] for x in spec["added_tokens"]}
    suffix = spec["model"]["end_of_word_suffix"]
    ranks = {}
    for token, rank in spec["model"]["vocab"].items():
        if token not in special:
            ended = token.endswith(suffix)
            body = token[: -len(suffix)] if ended else token
            ranks[bytes(symbols[c] for c in body) + (_END.encode() if ended else b"")] = rank
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})


def plain_words(text: str) -> list[str] | None:
    """The words of a text in the lower case, None where only the library is known to split it."""
    return _WORDS.findall(text.lower()) if _UNKNOWN.search(text) is None else None


def word_ids(text: str, vocab_path: str) -> np.ndarray:
    """Ids of a lower-casing word vocabulary with end-of-word marks."""
    if not text:
        return np.empty(0, np.uint32)
    if not plain(text):
        return library_ids(text, vocab_path)
    words = _WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint32)
    words.append("")
    return _word_encoding(vocab_path).encode_to_numpy(_END.join(words), disallowed_special=())
