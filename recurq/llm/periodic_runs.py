"""Runs of words that repeat with a period, as in generation that got stuck.

A run is a stretch of words with smallest period q, at least ``least_periods`` q and ``least_length`` words
long, that no word beside it extends with the same period. The Lyndon roots of a run show at one of two
orders of the words: for each order a stack, filled from right to left, gives every place its next smaller
suffix and so the longest Lyndon word that begins there. A place whose Lyndon word comes again twice is
extended to both sides. Suffixes are compared, and places extended, by the longest common extension: some
words directly, then a binary search over rolling hashes modulo 2**61 - 1. Every run is then compared word by
word, so a run that is returned is one. No suffix array is built.

Every word of a run stands in it ``least_periods`` times and more. So a text is first cut at the words that
are rarer in it, and each stretch that is left at those that are rarer in the stretch, until none is; only what
remains goes through the stack. Texts are independent of each other, and nothing shuffles.

Cases: a null or empty text, and one without words, has no run and collapses to an empty text; repeated rows
are searched each; a very long text takes its words and some numbers a word; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of

_MODULUS, _BASE = (1 << 61) - 1, 0x1B5A_79F1_D3C4_6E29 % ((1 << 61) - 1)
_powers = [1]


class Extensions:
    """Longest common extensions of places in a list of words, given as numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * _BASE % _MODULUS)
        self.sums = list(accumulate(words, lambda h, w: (h * _BASE + w + 1) % _MODULUS, initial=0))

    def equal(self, i: int, j: int, length: int) -> bool:
        """Whether the stretches of ``length`` at two places have equal hashes."""
        s, p = self.sums, _powers[length]
        return (s[i + length] - s[i] * p - s[j + length] + s[j] * p) % _MODULUS == 0

    def forward(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` > ``i`` on."""
        w, n = self.words, self.n
        for k in range(min(4, n - j)):
            if w[i + k] != w[j + k]:
                return k
        return self._search(n - j, lambda k: self.equal(i, j, k))

    def backward(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` > ``i``."""
        w = self.words
        for k in range(min(4, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        return self._search(i, lambda k: self.equal(i - k, j - k, k))

    @staticmethod
    def _search(most: int, holds) -> int:
        """The largest length up to ``most`` that ``holds``: doubled while it does, then halved."""
        low, step = min(4, most), 4
        while low < most and holds(min(most, low + step)):
            low, step = min(most, low + step), 2 * step
        high = min(most, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            if holds(middle):
                low = middle
            else:
                high = middle - 1
        return low


def lyndon(words: list[int], extensions: Extensions) -> list[int]:
    """For each place the length of the longest Lyndon word that begins there; the end is less than any word."""
    n, out, stack = len(words), [0] * len(words), [len(words)]
    forward = extensions.forward
    for i in range(n - 1, -1, -1):
        a = words[i]
        while (j := stack[-1]) < n:
            b = words[j]
            if a == b:
                k = forward(i, j)
                if j + k == n:
                    break  # the later suffix begins the earlier one, so it is less
                if words[i + k] > words[j + k]:
                    break
            elif a > b:
                break
            stack.pop()
        out[i] = stack[-1] - i
        stack.append(i)
    return out


def runs(words: list[int], least_length: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``least_periods`` is 3 or more."""
    n, around = len(words), Extensions(words)
    found: dict[int, list[tuple[int, int]]] = {}
    for order in (words, [-w for w in words]):
        for i, p in enumerate(lyndon(order, around)):
            # in a run of four periods its first root has two more periods behind it
            again = (least_periods - 2) * p
            if i + p + again > n or words[i] != words[i + p] or not around.equal(i, i + p, again):
                continue
            known = found.setdefault(p, [])
            if known and any(s <= i and i + 2 * p <= e for s, e in known[-2:]):
                continue
            start, end = i - around.backward(i, i + p), i + p + around.forward(i, i + p)
            if end - start >= max(least_length, least_periods * p):
                known.append((start, end))
    out = sorted({(s, e - s, p) for p, of in found.items() for s, e in of}, key=lambda r: (r[0], r[2]))
    for s, length, p in out:  # word by word
        e = s + length
        if words[s : e - p] != words[s + p : e] or (s and words[s - 1] == words[s - 1 + p]) or (e < n and words[e] == words[e - p]):
            raise ArithmeticError(f"hashes of unequal words agree at {s}, {length}, {p}")
    return out


def text_runs(words: list[bytes], least_length: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    often = {w for w, n in Counter(words).items() if n >= least_periods}
    out = []
    stretches = _stretches(words, often, least_length, 0) if often else []
    while stretches:
        start, part = stretches.pop()
        counts = Counter(part)
        kept = {w for w, n in counts.items() if n >= least_periods}
        if len(kept) < len(counts):
            stretches += _stretches(part, kept, least_length, start)
        else:
            number = {w: k for k, w in enumerate(sorted(counts))}
            out += [(start + s, length, p) for s, length, p in runs([number[w] for w in part], least_length, least_periods)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(words: list[bytes], kept: set[bytes], least: int, offset: int) -> list[tuple[int, list[bytes]]]:
    """Maximal stretches of at least ``least`` words of ``kept``, with their first places."""
    is_kept = bytes(map(kept.__contains__, words))
    return [(offset + m.start(), words[m.start() : m.end()]) for m in re.finditer(b"\x01{%d,}" % least, is_kept)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind the first period of a run, joined by single spaces."""
    if not found:
        return b" ".join(words)
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in found:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: Column | str = "text", least_length: int = 6, least_periods: int = 4, block_bytes: int = 1 << 22) -> DataFrame:
    """One row per row of ``df``: id, ``runs`` (array of start, length, period by word number, by start, then period), ``collapsed``.

    Words are maximal stretches without ASCII white space. ``least_periods`` is 3 or more.
    """
    if least_periods < 3:
        raise ValueError("least_periods must be 3 or more")
    schema = df.select(id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, found, texts = 0, 0, [], []

            def block(hi: int) -> pa.RecordBatch:
                of = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found], run)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), of, pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, "runs", "collapsed"])

            for k, text in enumerate(batch.column(1)):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                found.append(text_runs(words, least_length, least_periods))
                texts.append(collapsed(words, found[-1]))
                held += len(texts[-1])
                if held >= block_bytes:
                    yield block(k + 1)
                    lo, held, found, texts = k + 1, 0, [], []
            yield block(batch.num_rows)

    rows = df.select(id_col, (text_of(text) if isinstance(text, str) else text).alias("text"))
    return rows.mapInArrow(search, f"{schema}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """Texts of which one in ten, by its id, ends in a period: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")

    def planted(words: Column) -> Column:
        n, g = F.greatest(F.size(words), F.lit(1)), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(F.size(words) > 0, F.concat_ws(" ", at)).otherwise("")

    # within an array of one, so that the words are split once and not for each place
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), planted), 1)).otherwise(text)
