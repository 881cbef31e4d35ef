"""Exact, fast encoding with the ``word_bpe_49k.json`` tokenizer.

The tokenizer's text pipeline (normalise, split, byte level, merges) treats
every pre-token on its own, so ids can be remembered per word and per pre-token.  For texts
in the Latin ranges below, whose character classes are fixed, the split is done
here and only unseen pre-tokens reach the merges; a word with any other
character goes through the tokenizer itself.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from operator import attrgetter

#: The characters whose classes the quick way relies on.
_OUTSIDE = re.compile("[^\t\n\r -~¡-įı-ſ]|<\\|")
_LETTER = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_ID = attrgetter("id")
_PRETOKEN = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:[stmd]|re|ve|ll)|[^\\s{_LETTER}{_NUMBER}]+")

#: A worker's memory is bounded: it starts anew when it is full, and longer words
#: (whole texts, in scripts without blanks) are not remembered.
WORDS_BYTES, LONGEST = 144 << 20, 64
ENTRY_BYTES = 80  # of a dictionary, beside key and value


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """``encode(text)`` -> the ids as little-endian 16-bit (or 32-bit) words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model = self.tokenizer.model
        self.code = "H" if self.width == "<u2" else "I"
        if sys.byteorder != "little":
            raise NotImplementedError("ids are written in the machine's byte order, which must be little-endian")
        self.alphabet = _byte_alphabet()
        # a pre-token alone is a word of one pre-token, so both share a memory
        self.words = _Memory(self._word, WORDS_BYTES)

    def _pretoken(self, pretoken: str) -> bytes:
        if pretoken.isascii():
            mapped = pretoken
        else:
            mapped = "".join(map(self.alphabet.__getitem__, pretoken.encode()))
        return array(self.code, list(map(_ID, self.model.tokenize(mapped)))).tobytes()

    def _word(self, word: str) -> bytes:
        if _OUTSIDE.search(word) is None:
            lower = word.lower()
            if lower == word and word.isalpha():  # the most frequent kind: letters are one pre-token
                return self._pretoken(word)
            parts = _PRETOKEN.findall(lower)
            if parts == [word]:
                return self._pretoken(word)
            return b"".join(map(self.words.__getitem__, parts))
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        # blanks and line ends only: both are white space to the tokenizer, which joins nothing across them
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class _Memory(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.bytes = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            self.bytes += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
            if self.bytes > self.most:
                self.clear()
                self.bytes = 0
            self[key] = value
        return value


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """The process's own encoder: what one task has learnt, the next one uses."""
    return WordEncoder(path)
