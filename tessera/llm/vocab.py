"""Access to vocabulary files, once per worker process, and exact splitting of long texts.

Paths are parameters everywhere. A path must be readable on every executor.
"""

from __future__ import annotations

import base64
import functools
import os
import re

#: A space between two characters that aren't white space always starts a new match of the byte-level pattern
#: (no alternative ends with a space that follows a non-space), so a cut before it changes no token.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizers library's own object, on one thread: Spark decides the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def rank_table(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoding over a rank file."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens=dict(specials))


def safe_chunks(text: str, limit: int) -> list[str]:
    """Cuts a text into pieces of about `limit` characters at safe boundaries only; without one, a piece is longer."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out
