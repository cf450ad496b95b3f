"""64-bit hashes of words and word shingles, made from whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: A value for each byte, A-Z as a-z; white space is U+0020 and U+0009 to U+000D.
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 1 << 16), BASE, np.uint64)
        factors[0] = 1
        _POWERS = np.multiply.accumulate(factors)
    return _POWERS[:n]


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a block of UTF-8."""
    b = np.frombuffer(block, np.uint8)
    inside = ~_SPACE[b]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(b)
    power = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[b] * power[:n], out=total[1:])
    # the sum over a word, raised to the power that it has at the block's end: the same wherever the word stands
    return starts, mixed((total[ends] - total[starts]) * power[n - starts] * end_power(n) + (ends - starts).astype(np.uint64))


def end_power(n: int) -> np.uint64:
    """The inverse of BASE^n, so that hashes do not depend on the block's length."""
    return np.uint64(pow(pow(BASE, n, 1 << 64), -1, 1 << 64))


def combined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - n + 1 + j])
    return h


def blocks(texts: Iterable[str], size: int, without: bytes = b"") -> Iterator[list[bytes]]:
    """The texts in UTF-8, in lists of about ``size`` bytes, or one longer text."""
    held, total = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").translate(None, without)
        if held and total + len(raw) > size:
            yield held
            held, total = [], 0
        held.append(raw)
        total += len(raw)
    if held:
        yield held


def shingle_lists(texts: Iterable[str], n: int = 5, block: int = 1_000_000, without: bytes = b"") -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles of n words in order; with fewer words the whole sequence as one;
    none without words. ``without``: ASCII characters that are left out first."""
    for held in blocks(texts, block, without):
        ends = np.cumsum([len(x) + 1 for x in held])
        starts, words = word_hashes(b"\n".join(held))
        first = np.searchsorted(starts, np.concatenate([[0], ends]))
        whole = combined(words, n)
        for a, b in zip(first[:-1], first[1:]):
            yield whole[a : b - n + 1] if b - a >= n else combined(words[a:b], int(b - a)) if b > a else whole[:0]
