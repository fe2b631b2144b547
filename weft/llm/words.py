"""Letter words of whole texts, and arrays of their characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")
#: Word characters that are neither letters nor decimal digits: fractions, superscripts, letter numbers, circled digits.
_NUMERALS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
#: Marks before and after a word in its character array.
BEGIN, END = 2, 3
GROUP_CHARS = 1_000_000


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode category L)."""
    if not text:
        return []
    words = _WORD.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return _WORD.findall(_NUMERALS.sub(" ", text.lower()))


def groups(texts: list[str | None], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` characters: what is held as words at once."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, each between BEGIN and END; start of each word)."""
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return codes, np.flatnonzero(codes == BEGIN)


class Cache:
    """Rows of numbers for words, found once for each word that a worker meets; emptied when full."""

    def __init__(self, find, width: int, most: int = 400_000):
        self.find, self.width, self.most = find, width, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def __call__(self, lists: list[list[str]]) -> np.ndarray:
        """Rows of all words of the lists, one after another."""
        new = {w for words in lists for w in words}.difference(self.place)
        if len(self.place) + len(new) > self.most:
            self.clear()
            new = {w for words in lists for w in words}
        if new:
            n, added = len(self.place), sorted(new)
            self.place.update(zip(added, range(n, n + len(added))))
            while len(self.rows) < n + len(added):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(added)] = self.find(added)
        total = sum(map(len, lists))
        return self.rows[np.fromiter((self.place[w] for words in lists for w in words), np.int64, total)]
