"""Words, shingles and their 64-bit hashes, for whole Arrow batches.

``bytes.split()`` splits at exactly the six ASCII white-space bytes and
``bytes.lower()`` changes A-Z only, so both agree with the pattern
``[^\\x20\\x09-\\x0D]+`` whatever the script of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Rows of a batch whose texts are Python objects at once.
PIECE = 1024
#: A memo never holds more entries than this; it starts anew beyond.
MEMO_CAP = 800_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


class Memo(dict):
    """word -> value, computed once per process while it stays in the memo."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO_CAP:
            self.clear()
        value = self[key] = self.make(key)
        return value


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows in pieces of ``PIECE``, so that neither their objects nor what is made of them exists for a whole batch; what Arrow holds unused is given back at the end."""
    for b in batches:
        for i in range(0, b.num_rows, PIECE):
            yield b.slice(i, PIECE)
    pa.default_memory_pool().release_unused()


def hash_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def split_words(text: str | None) -> list[bytes]:
    """The ASCII-lower-cased words of a text; none for a null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of a splittable generator)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` successive word hashes, order-sensitive."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out + h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: list[bytes], memo: Memo, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles.

    Fewer words than ``n`` count as one shingle of their own; no words give an
    empty set.
    """
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, memo)
    if len(h) < n:
        # the number of words enters, so that short texts and shingles never meet
        return mix(windows_hash(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows_hash(h, n))
