"""Word hashes and shingle sets of whole texts, in numpy; used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 200_000


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Memo()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: A-Z in lower case, cut at ASCII white space."""
    if len(_hashes) > MEMO:
        _hashes.clear()
    words = text.encode().lower().split()  # on bytes both touch ASCII only
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: Odd factors for the first, second, ... word of a span.
_FACTORS = mix(np.arange(100, 116, dtype=np.uint64)) | np.uint64(1)


def spans_hashes(words: np.ndarray, masks: tuple[tuple[int, ...], ...]) -> list[np.ndarray]:
    """For each mask and each start, a hash of the words at these distances from it, in order.

    Word hashes are mixed already, so a sum of multiples is hash enough before the last mix; masks share the multiples.
    """
    scaled = [words * _FACTORS[k] for k in range(max(map(len, masks), default=0))]
    out = []
    for mask in masks:
        n = len(words) - mask[-1]
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        x = scaled[0][mask[0] : mask[0] + n] + np.uint64(sum(1 << o for o in mask))
        for k, o in enumerate(mask[1:], 1):
            x += scaled[k][o : o + n]
        out.append(mix(x))
    return out


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter sequence is one shingle, no words are none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(size, len(words))
    return np.unique(spans_hashes(words, (tuple(range(k)),))[0])
