"""Vectorised words of Arrow string batches: boundaries and 64-bit hashes without a Python object per word.

A word is a maximal run of ASCII letters and digits or bytes of non-ASCII characters, after folding
upper case of ASCII and of the Latin-1 letters. Hashes are polynomial with an odd base modulo 2**64,
then mixed; equal words have equal hashes in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[key] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))))
    return _powers[key]


@dataclass
class Words:
    """Words of several texts. ``first[i]:first[i+1]`` are those of text ``i``; starts and ends are bytes in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    base: int

    def prefix_hash(self, which: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of the given words, which must be that long."""
        s = self.starts[which] - self.base
        h = np.zeros(len(s), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length - 1, -1, -1):
                h = h * _BASE + self.data[s + k].astype(np.uint64) + np.uint64(1)
        return mix(h)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes each, a longer text alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, piece: int = 1 << 21) -> Words:
    """The words of texts ``lo`` to ``hi``.

    The bytes go by in pieces of about ``piece``, cut between words, so that a very long text takes its
    own size and a few numbers a word. The result does not depend on the cuts.
    """
    a, b = int(offsets[lo]), int(offsets[hi])
    if b - a <= piece:
        part, starts, ends, hashes = _words(data, offsets, lo, hi, a, b)
    else:
        cuts = [a]
        while cuts[-1] < b:
            cut = min(cuts[-1] + piece, b)
            # between words: after a byte that belongs to none
            while cut < b and not len(outside := np.flatnonzero(~_IS_WORD[_LOWER[data[cut : cut + 4096]]])):
                cut += 4096
            cuts.append(min(b, cut + int(outside[0]) + 1) if cut < b else b)
        parts = [_words(data, offsets, lo, hi, x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        shift = [x - a for x in cuts[:-1]]
        part, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[3] for p in parts])
        starts, ends = (np.concatenate([p[k] + d for p, d in zip(parts, shift, strict=True)]) for k in (1, 2))
    first = np.searchsorted(starts, offsets[lo : hi + 1] - a)
    return Words(part, starts + a, ends + a, hashes, first, a)


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, a: int, b: int) -> tuple[np.ndarray, ...]:
    """Folded bytes ``a`` to ``b``; starts, ends and hashes of their words, counted from ``a``."""
    part = _LOWER[data[a:b]]
    if b > a:  # upper case of the Latin-1 letters: second bytes 80 to 9E after C3, but for the times sign
        latin = np.flatnonzero(part[:-1] == 0xC3) + 1
        second = part[latin]
        part[latin] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    is_word = _IS_WORD[part]
    bounds = np.zeros(b - a + 1, bool)
    inside = offsets[lo : hi + 1]
    bounds[inside[(inside >= a) & (inside <= b)] - a] = True
    before = np.concatenate(([False], is_word[:-1])) if b > a else is_word
    after = np.concatenate((is_word[1:], [False])) if b > a else is_word
    starts = np.flatnonzero(is_word & (~before | bounds[:-1]))
    ends = np.flatnonzero(is_word & (~after | bounds[1:])) + 1
    with np.errstate(over="ignore"):
        powers = _power(_BASE, b - a + 1)[: b - a]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
        hashes = mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, b - a + 1)[starts])
    return part, starts, ends, hashes


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and where each text's begin (as ``first``)."""
    total = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(total, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + hashes[k : k + total]
        h = mix(h)
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    keep = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    return h[keep], at
