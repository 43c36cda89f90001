"""Counts over one text that the quality rules and the quality classifier share.

Words are runs of bytes other than ASCII white space, which is what the pattern [^\\x20\\x09-\\x0D]+ finds in
the text, since no byte of a longer UTF-8 sequence is white space.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Fixed by the contract of the quality rules.
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:"
#: Texts with more words than this count their windows by arrays instead of tuples.
MANY_WORDS = 100_000


def having(data: bytes, kinds: bytes) -> int:
    """How many bytes of data are one of kinds."""
    return len(data) - len(data.translate(None, kinds))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of size words found twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) > MANY_WORDS:
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        codes = ids
        for k in range(1, size):
            codes = np.unique(codes[: len(ids) - k] * (len(names) + 1) + ids[k:], return_inverse=True)[1].astype(np.int64)
        starts = np.bincount(codes)[codes] > 1
    else:
        windows = list(zip(*(words[k:] for k in range(size)), strict=False))
        counts = Counter(windows)
        if len(counts) == n:
            return 0
        starts = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= starts
    return int(covered.sum())


def base_counts(text: str, data: bytes, words: list[bytes], lines: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; lines are those with a word."""
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, having(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def split(text: str) -> tuple[bytes, list[bytes], list[bytes]]:
    """The text's bytes, words and lines with a word."""
    data = text.encode("utf-8")
    return data, data.split(), [line for line in data.split(b"\n") if not line.isspace() and line]
