"""Word hashes of many texts at once, in numpy.

Texts are joined into one byte array; a byte table says which bytes part words
and how letters fold.  A word's hash is the sum of a mixed 64-bit value for
each byte at its place in the word, taken from prefix sums, then mixed.  No loop
runs over words.  (A polynomial modulo 2^64 would not do: in any base, Thue-Morse
words of 1,024 letters and their complements have one value.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low bits are as good as high ones."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Mixed values of bytes at a word's first places, looked up instead of worked out; the others are worked out alike.
_PLACES = 24
_VALUES = mixed(np.arange(_PLACES << 9, dtype=np.uint64))


def byte_table(separators: bytes | None = None, letters: bytes | None = None) -> np.ndarray:
    """Value of each byte, 0 for one that parts words; A-Z fold to a-z. Give the separators or the letters."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    if separators is not None:
        table[list(separators)] = 0
    else:
        inside = np.zeros(256, bool)
        inside[list(letters or b"")] = True
        table[~inside] = 0
    return table


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in a byte array."""
    values = table[data]
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = values != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.zeros(len(values), np.int32)
    first[starts] = starts
    place = np.arange(len(values), dtype=np.int32) - np.maximum.accumulate(first)
    each = _VALUES[(np.minimum(place, _PLACES - 1) << 9) | values]
    if len(far := np.flatnonzero(place >= _PLACES)):
        each[far] = mixed((place[far].astype(np.uint64) << np.uint64(9)) | values[far])
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    return starts, ends, mixed(sums[ends] - sums[starts])


def blocks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about ``most`` bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        if held and size + len(data) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def words_of(held: list[bytes], table: np.ndarray, separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) for each word of the texts, in order."""
    joined = np.frombuffer(separator.join(held), np.uint8)
    starts, _, hashes = words(joined, table)
    ends = np.cumsum([len(x) + 1 for x in held])
    return np.searchsorted(ends, starts, side="right"), hashes
