"""Texts as arrays of letters, and their n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower, letter, digit = np.arange(65536, dtype=np.uint32), np.zeros(65536, bool), np.zeros(65536, bool)
    for c in range(65536):
        s = chr(c)
        letter[c], digit[c] = s.isalpha(), s.isdigit()
        if letter[c] and len(s.lower()) == 1:
            lower[c] = ord(s.lower())
    return lower, letter, digit


class Letters:
    """Lower-case code points of texts, with 0 for what isn't of a word, and 0 around each text."""

    def __init__(self, digits: bool = True) -> None:
        self.lower, self.letter, digit = _tables()
        self.word = self.letter | digit if digits else self.letter

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes, and the n + 1 offsets of the texts in them (a text's part begins and ends with a 0)."""
        joined = "\n\n".join(texts)
        raw = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.dtype("<u4"))
        offsets = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
        small = np.minimum(raw, 65535)
        codes = np.where(self.word[small], self.lower[small], 0).astype(np.uint32)
        if (far := raw > 65535).any():
            found = np.unique(raw[far])
            good = found[[chr(c).isalpha() for c in found]]
            codes[far] = np.where(np.isin(raw[far], good), raw[far], 0)
        return codes, offsets


def ngrams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the n-grams that lie in a word, whose one edge on either side counts as a letter (so a whole short word is one too)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = np.ones(m, bool)
    for k in range(1, n - 1):
        ok &= codes[k : m + k] != 0
    if n < 3:
        ok &= (codes[:m] != 0) & (codes[n - 1 :] != 0)
    at = np.flatnonzero(ok)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


def chunks(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts of at most so many characters, or one text each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 2
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


#: Kinds of bytes: 0 white space, 1 of words, 2 other.
KINDS = np.full(256, 2, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
