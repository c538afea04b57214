"""Token ids of a public word tokenizer, with caches of words.

The vocabulary's own rule splits a text into words before any merge, and no
word holds white space, so the ids of a text are those of its words side by
side.  Texts in Latin-1 characters are cut at white space here; each distinct
run is split by the same rule and each distinct word goes once through the
tokenizer's merges.  A text with any other character, or with the string of a
special token, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import re

import numpy as np

_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = r"\t-\r \x85\xa0"
#: The split rule of the vocabulary file, spelled out for lower-case Latin-1. Fixed value.
WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Latin-1 without the four separators that str.split() takes as white space and the rule does not.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str | None = None, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.words = _Cache(self._word, cached)
        self.runs = _Cache(self._run, cached)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        if not word.isprintable():
            spelled = "".join([self.letters[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORD.findall(run)))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit bytes."""
        if _PLAIN.match(text) and not any(s in text for s in self.special):
            return b"".join(map(self.runs.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
