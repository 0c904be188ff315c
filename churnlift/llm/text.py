"""Words, word hashes and n-gram hashes shared by the text operators.

A word is a maximal run of bytes other than the six ASCII white-space
characters (0x20, 0x09-0x0D).  UTF-8 never uses those bytes inside a longer
sequence, so ``bytes.split()`` yields exactly these words.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of the per-process word-hash cache before it is emptied.
CACHE_WORDS = 200_000
#: Bytes of the longest word that a cache keeps.
CACHED_BYTES = 64

_U = np.uint64


def utf8(text) -> bytes:
    """UTF-8 bytes; null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


class WordHashes(dict):
    """64-bit hash of a word, kept for words met again (bounded)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, in text order.

    Runs are put together from runs of 1, 2, 4, ... words, so the cost is
    O(len * log n); equal word sequences get equal hashes.
    """
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, _U)
    out, done, size, block = None, 0, 1, h
    while True:
        if n & size:
            part = block[done:done + count]
            out = mix(part + _U(size)) if out is None else mix(out * _U(0x9E3779B97F4A7C15) + part)
            done += size
        size *= 2
        if size > n:
            return out
        half = size // 2
        block = mix(block[:-half] * _U(0xD6E8FEB86659FD93) + block[half:] + _U(half)) if len(block) > half else block[:0]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes; a shorter text is one shingle."""
    if not len(h):
        return np.empty(0, _U)
    return np.unique(grams(h, min(n, len(h))) + _U(min(n, len(h))))


def covered(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Mask of the words inside any window of ``width`` words at ``starts``."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]
