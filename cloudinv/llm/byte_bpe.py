"""Byte-level BPE ids of texts, through a bounded cache of chunks.

A single space between two characters that are no white space always begins a new pre-token,
and nothing before it is changed by what follows. So a text is split there, and the ids of a
chunk are looked up, or encoded once. The fast encoder overflows on very long runs of white space;
texts that hold one go through the other public tokenizer, which gives the same ids.
"""

import base64
import re
import sys
from array import array

import tiktoken
from tokenizers import Tokenizer

END_OF_TEXT = "<|endoftext|>"
#: A space beside other white space, where a split at the space would change pre-tokens.
UNSAFE = re.compile(r" \s|\s ")
#: White space beyond this length; the fast encoder fails just below a million.
LONG = 65536
LONG_BLANK = re.compile(rf"\s{{{LONG}}}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoding(ranks_path: str, special: dict[str, int]) -> tiktoken.Encoding:
    import public_tokenizers

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Chunks(dict):
    """Chunk -> its ids as little-endian 32-bit numbers."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = _packed(self.encode(chunk))
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    """An end-of-text mark within a text is its one id, as the public file has it."""

    def __init__(self, ranks_path: str | None = None, limit: int = 300_000, json_path: str | None = None):
        self.bpe = encoding(ranks_path or default_ranks(), {END_OF_TEXT: 50256})
        self.json_path, self.slow = json_path, None
        self.plain = _Chunks(self.bpe.encode_ordinary, limit)

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if len(text) >= LONG and LONG_BLANK.search(text):
            self.slow = self.slow or Tokenizer.from_file(self.json_path or default_json())
            return _packed(self.slow.encode(text, add_special_tokens=False).ids)
        if END_OF_TEXT in text or UNSAFE.search(text):
            return _packed(self.bpe.encode(text, allowed_special="all"))
        first, *rest = text.split(" ")
        known = self.plain
        return known[first] + b"".join([known[" " + c] for c in rest])

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_MADE: dict[str | None, Encoder] = {}


def encoder(ranks_path: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    if ranks_path not in _MADE:
        _MADE[ranks_path] = Encoder(ranks_path)
    return _MADE[ranks_path]
