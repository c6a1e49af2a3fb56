"""Character classes of Unicode 16.0, which the tokenizer libraries split texts by; this interpreter's own tables may be older."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Letters and numbers that Unicode 16.0 added to 15.1, as ranges, ends included.
ADDED = {
    LETTER: [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    NUMBER: [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
#: White space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Lower-case forms that Unicode 16.0 and 17.0 added, as first, last and the form of the first.
LOWERED = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    by_category = {"L": LETTER, "N": NUMBER}
    kinds = np.fromiter((by_category.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in ADDED.items():
        for first, last in ranges:
            kinds[first : last + 1] = kind
    kinds[SPACES] = SPACE
    return kinds


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_LOWER = {c: to + c - first for first, last, to in LOWERED for c in range(first, last + 1)}
_ANY_LOWERED = {chr(c) for c in _LOWER}


def lower(text: str) -> str:
    """The text in lower case, character by character (a sigma is the same wherever it stands)."""
    text = text.replace("Σ", "σ").lower()
    return text if text.isascii() or _ANY_LOWERED.isdisjoint(text) else text.translate(_LOWER)
