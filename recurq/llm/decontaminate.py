"""Benchmark decontamination: pieces of items that edits leave, met in every text, and exact edit verification.

Texts and items are sequences of folded words, joined by one space. An item is cut into disjoint grams of characters,
more than the edits that are allowed. An edit spoils one at most, so any text within the distance holds a known number of
them as they are, at places that differ by the edits at most; every window with so many is verified, and none is left
out (``Pieces``). Which grams are pieces, and how many, follows from a sample of the documents and bears on the cost only.

CGK random walks with bit sampling, which this operator had before, can't give right results at a similarity of 0.8:
item-sized walks agree no more often than those of strangers there, and shorter ones found no window that pieces do not
find (README has the figures). They are gone.

Verification is exact: the least edit distance, in characters of the folded words joined by one space,
between the item and any substring of the candidate's surroundings. A document contains an item if
1 - distance / item length is at least ``similarity``. The table of all candidates of a block is filled in step,
64 rows to a word; pieces of an item are edited no more than the whole, so most candidates go after the first.

Items go to the executors in blocks of at most ``block_items`` rows and about ``block_bytes`` bytes, one pass over the
documents for each. Documents are read whole, in place, and nothing of them shuffles. A very long text goes by in
pieces (``wordhash.words``), candidates in chunks.

Cases: null or empty texts and items without a word match nothing; an item of one common word is met wherever that
occurs; repeated rows are each reported; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import maybe_broadcast, written
from .wordhash import Words, blocks, buffers, words

#: Characters of the items that are compared with their windows together.
_CHUNK = 1 << 20
#: Characters of the longest piece of an item, and what a window costs against a piece that is met.
_LONGEST_PIECE, _WINDOW_COST = 8, 2000.0
#: Rows and characters of the sample by which pieces are chosen.
_SAMPLE_ROWS, _SAMPLE_CHARS = 400, 800_000
#: Cells of starts that are counted together.
_CELLS = 1 << 17
#: Characters of an item beyond which its windows are compared one by one, on whole numbers as long as the item.
_LONG_ITEM = 4096


class Index:
    """Distinct sorted keys, and the place of each among them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(24, max(12, int(len(keys)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        slot = (keys >> self.shift).astype(np.int64)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        crowded = slot[1:][slot[1:] == slot[:-1]]
        self.table[crowded] = -2

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``wanted`` that are keys, and which keys they are."""
        slot = self.table[wanted >> self.shift]
        at = np.flatnonzero(slot != -1)
        which = slot[at].astype(np.int64)
        crowded = which == -2
        if crowded.any():
            which[crowded] = np.minimum(np.searchsorted(self.keys, wanted[at[crowded]]), len(self.keys) - 1)
        same = self.keys[which] == wanted[at]
        return at[same], which[same]


def folded(found: Words, a: int, b: int) -> str:
    """Words ``a`` to ``b`` joined by a space."""
    data, base = found.data, found.base
    return b" ".join(data[s - base : e - base].tobytes() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)).decode("utf-8", "replace")


def least_edits(item: str, text: str) -> tuple[int, int]:
    """The least edit distance between ``item`` and any substring of ``text``, and where the first best one ends."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
        if score < best:
            best, end = score, k + 1
    return best, end


class Items:
    """A block of items as words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = buffers(texts)
        self.words = found = words(data, offsets, 0, len(texts))
        self.strings = [folded(found, found.first[i], found.first[i + 1]) for i in range(len(texts))]
        self.lengths = np.diff(found.first)


def allowed(strings: list[str], similarity: float) -> np.ndarray:
    """The most edits of each item."""
    return np.array([math.floor(len(t) * (1 - similarity) + 1e-9) for t in strings], np.int64)


class Pieces:
    """Disjoint grams of characters of each item, more than may be edited: text within the allowed distance holds ``need`` of them unedited.

    An edit spoils one piece at most, so ``most`` edits leave ``need`` of ``most + need`` pieces as they are. Those that are rare in
    ``sample`` and among the items are taken, which only bears on the cost.
    """

    def __init__(self, strings: list[str], most: np.ndarray, sample: np.ndarray):
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in strings]
        sizes = np.array([len(c) for c in codes], np.int64)
        self.size = np.minimum(sizes // (most + 1), _LONGEST_PIECE)
        self.need = np.zeros(len(strings), np.int64)
        item, offset, keys, self.sizes = [], [], [], np.unique(self.size[self.size > 0]).tolist()
        for size in self.sizes:
            own = np.flatnonzero(self.size == size)
            grams = [character_grams(codes[i], size) for i in own]
            distinct, which, count = np.unique(np.concatenate([character_grams(sample, size), *grams]), return_inverse=True, return_counts=True)
            common = count[which[-sum(map(len, grams)) :]] / len(which)
            at = 0
            for i, gram in zip(own, grams, strict=True):
                places = _cheapest(common[at : at + len(gram)], size, int(most[i]))
                self.need[i] = len(places) - most[i]
                at += len(gram)
                item.append(np.full(len(places), i))
                offset.append(places)
                keys.append(gram[places])
        item, offset, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, offset, keys))
        order = np.lexsort((keys, self.size[item]))
        self.item, self.offset, keys = item[order], offset[order], keys[order]
        self.tables = []
        for size in self.sizes:
            rows = np.flatnonzero(self.size[self.item] == size)
            distinct, begin, count = np.unique(keys[rows], return_index=True, return_counts=True)
            self.tables.append((size, Index(distinct), rows[0] + begin, count))


def _cheapest(cost: np.ndarray, size: int, most: int) -> np.ndarray:
    """Where disjoint grams of ``size`` begin, more than ``most`` of them, for which meeting them and the windows that hold enough by
    chance cost least. ``cost`` is the share of the gram at each place in a text."""
    n = len(cost) + size - 1
    wanted = n // size
    if n > _LONG_ITEM:  # one after the other: the table is as large as the square of the item
        return np.arange(wanted) * size
    best = np.full((n + 1, wanted + 1), np.inf)
    best[:, 0] = 0
    for end in range(1, n + 1):
        best[end] = best[end - 1]
        if end >= size:
            np.minimum(best[end, 1:], best[end - size, :-1] + cost[end - size], out=best[end, 1:])
    # pieces come in clusters, so by chance thrice as many are taken to meet in a window of ``most + 1`` starts
    chance = [1 - sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(need)) if (x := 3 * (most + 1) * b) > 0 else 0 for need, b in enumerate(best[n, most + 1 :], 1)]
    wanted = most + 1 + int(np.argmin(best[n, most + 1 :] + _WINDOW_COST * np.maximum(chance, 0) / (most + 1)))
    places, end = [], n
    for left in range(wanted, 0, -1):
        while best[end, left] == best[end - 1, left]:
            end -= 1
        end -= size
        places.append(end)
    return np.array(places[::-1], np.int64)


def character_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` characters, one for each start."""
    n = max(0, len(codes) - size + 1)
    key = codes[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, size):
            key *= np.uint64(0x100000001B3)
            key += codes[k : k + n]
        key *= np.uint64(0x9E3779B97F4A7C15)
    return key


def spread(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value ``count`` times, and beside it the numbers from ``begin`` on."""
    skip = begin - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else begin
    return np.repeat(values, count), np.repeat(skip, count) + np.arange(int(count.sum()))


class Matcher:
    """A block of items, and the search for them in blocks of texts."""

    def __init__(self, items: list[tuple[int, str]] | Items, similarity: float, pieces: Pieces | None = None):
        block = items if isinstance(items, Items) else Items(items)
        self.items, self.strings, self.lengths = block.items, block.strings, block.lengths
        self.most = allowed(self.strings, similarity)
        self.sizes = np.array([len(t) for t in self.strings], np.int64)
        self.pieces = pieces or Pieces(self.strings, self.most, np.zeros(0, np.uint32))
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.strings]
        self.alphabet = np.unique(np.concatenate([*codes, np.zeros(1, np.uint32)]))
        self.letters = [np.searchsorted(self.alphabet, c) for c in codes]

    def _by_pieces(self, codes: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, least start, largest start) of all windows that hold as many pieces of an item as any text within the allowed
        distance. ``codes`` are the characters of all words, joined; text ``i`` begins at ``text_at[i]``.

        Unedited pieces of one occurrence begin it at most ``most`` apart. Starts are counted by cells as wide, two
        neighbours together, and what has enough is looked at start by start.
        """
        pieces, half = self.pieces, self.most + 1
        # an item all of whose characters may be edited has no pieces, and is in every text
        free, end = np.flatnonzero((pieces.need == 0) & (self.sizes > 0)), np.append(text_at[1:], len(codes))
        text = np.flatnonzero(end > text_at)
        out = [(np.repeat(text, len(free)), np.tile(free, len(text)), np.repeat(text_at[text], len(free)), np.repeat(end[text], len(free)))] if len(free) else []
        overlap = 2 * int((self.sizes + self.most).max(initial=0))
        chunk = max(4 * overlap, 1 << 12, int(_CELLS / max(1e-9, float((1 / half).sum()))))
        per_cell, length = 1.0 / half[pieces.item], -1
        for lo in range(0, len(codes), chunk):
            part = codes[lo : lo + chunk + overlap]
            if len(part) != length:
                # starts count from ``overlap`` before the part
                length, cells = len(part), (len(part) + overlap) // half + 2
                base = np.cumsum(cells) - cells
                first_cell = base[pieces.item] + (overlap + 0.5 - pieces.offset) * per_cell
                need, n_cells = np.repeat(pieces.need, cells), int(cells.sum())
            hits, rows = [], []
            for size, index, begin, count in pieces.tables:
                hit, which = index.find(character_grams(part, size))
                at, row = spread(hit, begin[which], count[which])
                hits.append(at)
                rows.append(row)
            at, row = (x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits, rows))
            cell = per_cell.take(row)
            cell *= at
            cell += first_cell.take(row)
            cell = cell.astype(np.int64)
            counts = np.bincount(cell, minlength=n_cells + 1)
            pair = counts[:-1] + counts[1:] >= need
            good = np.concatenate((pair, [False]))
            good[1:] |= pair
            some = np.flatnonzero(good.take(cell))
            at, row = at[some] + lo, row[some]
            item, text, start = pieces.item[row], np.searchsorted(text_at, at, "right") - 1, at - pieces.offset[row]
            order = np.argsort((text * len(pieces.need) + item) * (2 * len(codes) + 4 * overlap) + start, kind="stable")
            start, item, text, row = start[order], item[order], text[order], row[order]
            last = np.arange(len(item)) + pieces.need[item] - 1
            at = np.flatnonzero(last < len(item))
            last = last[at]
            at = at[(item[at] == item[last]) & (text[at] == text[last]) & (start[last] - start[at] <= self.most[item[at]])]
            # a piece that is met again within a window counts once
            again = np.argsort(text * len(pieces.item) + row, kind="stable")
            before = np.full(len(row), -1)
            before[again[1:]] = np.where((row[again[1:]] == row[again[:-1]]) & (text[again[1:]] == text[again[:-1]]), again[:-1], -1)
            reach = (text * len(pieces.need) + item) * (2 * len(codes) + 4 * overlap) + start
            last = np.searchsorted(reach, reach[at] + self.most[item[at]], "right")
            window, place = spread(np.arange(len(at)), at, last - at)
            enough_here = np.bincount(window[before[place] < at[window]], minlength=len(at)) >= pieces.need[item[at]]
            at, last = at[enough_here], last[enough_here] - 1
            if len(at):
                # those that begin in one cell are one window
                cell = start[at] // half[item[at]]
                new = np.flatnonzero(np.concatenate(([True], (text[at][1:] != text[at][:-1]) | (item[at][1:] != item[at][:-1]) | (cell[1:] != cell[:-1]))))
                out.append((text[at[new]], item[at[new]], start[at[new]], np.maximum.reduceat(start[last], new)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def search(self, found: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, after the last word, edits) of every text that contains an item, its best place."""
        if not len(found.hashes) or not self.lengths.any():
            return []
        codes, _ = window_characters(found, np.array([0]), np.array([len(found.hashes)]))
        if codes is None:  # bytes that are no UTF-8 are replaced, as in ``folded``
            data, offsets = buffers(pa.array([folded(found, a, b) for a, b in zip(found.first[:-1], found.first[1:], strict=True)], pa.string()))
            found = words(data, offsets, 0, len(offsets) - 1)
            codes, _ = window_characters(found, np.array([0]), np.array([len(found.hashes)]))
        at_char = character_places(found)
        text_at = np.concatenate((at_char, [len(codes)]))[found.first[:-1]]
        text, item, low, high = self._by_pieces(codes, text_at)
        order = np.lexsort((-high, low, item, text))
        text, item, low, high = text[order], item[order], low[order], high[order]
        # starts within earlier ones of the same text and item add nothing
        group = np.cumsum(np.concatenate(([False], (text[1:] != text[:-1]) | (item[1:] != item[:-1]))))[: len(text)]
        reach = group * (at_char[-1] + self.sizes.max() + 2) * 2 + high
        new = np.flatnonzero(np.concatenate(([True], reach[1:] > np.maximum.accumulate(reach)[:-1]))) if len(reach) else order
        # windows of a size go together
        new = new[np.argsort(self.sizes[item[new]] * (1 << 20) + (high - low)[new], kind="stable")]
        text, item, low, high = text[new], item[new], low[new], high[new]
        # an unedited word of the item is at most ``most`` characters off its place
        low, high = low - self.most[item], high + self.most[item]
        a = np.maximum(found.first[text], np.searchsorted(at_char, low, "right") - 1)
        b = np.minimum(found.first[text + 1], np.searchsorted(at_char, high + self.sizes[item], "left"))
        low, high = low - at_char[a], high - at_char[a]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        weight = np.cumsum(self.sizes[item] + 64)
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(weight, weight[lo] + _CHUNK, "right")))
            for k, e, end in self._edits(found, item[lo:hi], a[lo:hi], b[lo:hi], low[lo:hi], high[lo:hi]):
                t, i, start = int(text[lo + k]), int(item[lo + k]), int(a[lo + k])
                base = int(found.first[t])
                after = start + folded(found, a[lo + k], b[lo + k]).count(" ", 0, end) + 1
                place = (e, max(start, after - int(self.lengths[i])) - base, after - base)
                if (t, i) not in best or place < best[t, i]:
                    best[t, i] = place
            lo = hi
        return [(t, i, first, after, e) for (t, i), (e, first, after) in sorted(best.items())]

    def _edits(self, found: Words, item: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
        """(which, edits, end) of the windows that hold their item: its least edit distance to a substring, and where the first best one ends.

        The item begins between characters ``low`` and ``high`` of its window.
        """
        codes, bounds = window_characters(found, a, b)
        if codes is None or self.sizes[item].max() > _LONG_ITEM:
            each = [(k, *least_edits(self.strings[i], folded(found, x, y))) for k, (i, x, y) in enumerate(zip(item, a, b, strict=True))]
            return [x for x in each if x[1] <= self.most[item[x[0]]]]
        letters = np.searchsorted(self.alphabet, codes)
        letters[self.alphabet[np.minimum(letters, len(self.alphabet) - 1)] != codes] = len(self.alphabet)
        letters[bounds[1:] - 1] = len(self.alphabet)  # the space after a window is none of its characters
        own, which = np.unique(item, return_inverse=True)
        patterns = [self.letters[i] for i in own]
        left = np.arange(len(item))
        # Pieces of an item are edited no more than the whole: windows too far from the first pieces go.
        n_pieces, spent = -(-self.sizes[own] // 64), np.zeros(len(item), np.int64)
        for piece in range(int(n_pieces.max())):
            have = n_pieces > piece
            at = self.sizes[own] * piece // n_pieces
            parts = [p[int(x) : int(y)] if h else p[:1] for p, h, x, y in zip(patterns, have, at, self.sizes[own] * (piece + 1) // n_pieces, strict=True)]
            some = left[have[which[left]]]
            if not len(some):
                break
            begin = np.maximum(0, low[some] + at[which[some]])
            end = np.minimum(np.diff(bounds)[some], high[some] + at[which[some]] + np.array([len(x) for x in parts])[which[some]])
            x, y = spread(some, bounds[some] + begin, np.maximum(0, end - begin))[1], np.concatenate(([0], np.cumsum(np.maximum(0, end - begin))))
            spent[some] += many_least_edits(parts, which[some], letters[x], y, len(self.alphabet))[0]
            left = left[spent[left] <= self.most[item[left]]]
        if not len(left):
            return []
        x, y = spread(left, bounds[left], np.diff(bounds)[left])[1], np.concatenate(([0], np.cumsum(np.diff(bounds)[left])))
        edits, ends = many_least_edits(patterns, which[left], letters[x], y, len(self.alphabet))
        good = edits <= self.most[item[left]]
        return list(zip(left[good].tolist(), edits[good].tolist(), ends[good].tolist(), strict=True))


def many_least_edits(patterns: list[np.ndarray], which: np.ndarray, letters: np.ndarray, bounds: np.ndarray, n_letters: int) -> tuple[np.ndarray, np.ndarray]:
    """``least_edits`` of pattern ``which[k]`` and text ``letters[bounds[k]:bounds[k + 1]]`` for all k at once.

    Letters are small numbers; ``n_letters`` stands for one that no pattern has. Columns of the table are differences
    of its rows in words of 64 bits, carried from word to word; one column of all texts is done at a time.
    """
    sizes = np.array([len(x) for x in patterns], np.int64)
    n_words, n = int(-(-sizes.max() // 64)), len(which)
    masks = np.zeros((len(patterns), n_letters + 1, n_words), np.uint64)
    for i, pattern in enumerate(patterns):
        at = np.arange(len(pattern))
        np.bitwise_or.at(masks[i], (pattern, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    lengths = np.diff(bounds)
    columns = np.full((int(lengths.max(initial=0)), n), n_letters, np.int64)
    columns[np.arange(len(letters)) - np.repeat(bounds[:-1], lengths), np.repeat(np.arange(n), lengths)] = letters
    columns += which * (n_letters + 1)
    masks = np.ascontiguousarray(masks.reshape(-1, n_words).T)
    size = sizes[which]
    last_word, last = (size - 1) >> 6, np.uint64(1) << ((size - 1) & 63).astype(np.uint64)
    ends_in = [np.where(last_word == w, last, np.uint64(0)) for w in range(n_words)]
    one, top = np.uint64(1), np.uint64(63)
    plus, minus = [np.full(n, ~np.uint64(0)) for _ in range(n_words)], [np.zeros(n, np.uint64) for _ in range(n_words)]
    score, best, end = size.copy(), size.copy(), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for j, column in enumerate(columns):
            up_in = down_in = None
            for w in range(n_words):
                pv, mv, equal = plus[w], minus[w], masks[w].take(column)
                xv = equal | mv
                if w:
                    equal |= down_in
                xh = equal & pv
                xh += pv
                xh ^= pv
                xh |= equal
                down = pv & xh
                xh |= pv
                up = mv | ~xh
                score += (up & ends_in[w]) != 0
                score -= (down & ends_in[w]) != 0
                if w + 1 < n_words:
                    up_out, down_out = up >> top, down >> top
                up <<= one
                down <<= one
                if w:
                    up |= up_in
                    down |= down_in
                minus[w] = up & xv
                xv |= up
                plus[w] = down | ~xv
                if w + 1 < n_words:
                    up_in, down_in = up_out, down_out
            better = np.flatnonzero(score < best)
            best[better], end[better] = score[better], j + 1
    return best, end


def character_places(found: Words) -> np.ndarray:
    """Where each word begins, in characters of all words joined by one space."""
    if not len(found.starts):
        return np.zeros(0, np.int64)
    follows = (found.data & 0xC0) == 0x80
    length = found.ends - found.starts - np.add.reduceat(follows, found.starts - found.base, dtype=np.int64)
    return np.cumsum(length + 1) - length - 1


def window_characters(found: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The code points of windows of words joined by a space, one after the other, and where each begins; None if they are no UTF-8."""
    _, which = spread(a, a, b - a)
    starts, lengths = found.starts[which] - found.base, found.ends[which] - found.starts[which]
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lengths + 1)
    joined = found.data[np.minimum(at, len(found.data) - 1)]
    joined[begin[1:] - 1] = ord(" ")
    first = np.cumsum((joined & 0xC0) != 0x80)
    windows = np.concatenate(([0], np.cumsum(b - a)))
    bounds = np.concatenate(([0], first[begin[windows[1:]] - 1]))
    try:
        return np.frombuffer(joined.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), bounds
    except UnicodeDecodeError:
        return None, bounds


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = 20_000, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, first_word, after_word, edits, similarity."""
    spark = documents.sparkSession
    id_type = documents.select(id_col).schema.fields[0].dataType.simpleString()
    item_type = benchmark.select(item_col).schema.fields[0].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, first_word long, after_word long, edits long, similarity double"
    named = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    # rows that are equal in all their columns go to different blocks, too
    items = written(named.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "items")
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["rows"] // block_items), -(-size["bytes"] // block_bytes))
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heads = [r.text for r in source.select(F.substring("text", 1, _SAMPLE_CHARS // _SAMPLE_ROWS).alias("text")).take(_SAMPLE_ROWS)]
    head = words(*buffers(pa.array(heads, pa.string())), 0, len(heads))
    sample = np.frombuffer(folded(head, 0, len(head.hashes)).encode("utf-32-le"), np.uint32)
    out = None
    for block in range(n_blocks):
        rows = [(r.item_id, r.text) for r in items.filter(F.pmod("deal", F.lit(n_blocks)) == block).select("item_id", "text").collect()]
        items_of = Items(rows)
        if not items_of.lengths.any():
            continue
        pieces = Pieces(items_of.strings, allowed(items_of.strings, similarity), sample)
        part = source.mapInArrow(_searcher(spark.sparkContext.broadcast((items_of, pieces)), similarity, to_arrow_type(named.schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def _searcher(shared, similarity: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(shared.value[0], similarity, shared.value[1])
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0)
            out: list[tuple] = []
            for lo, hi in blocks(offsets, 1 << 22):
                for t, i, a, b, edits in matcher.search(words(data, offsets, lo, hi)):
                    out.append((ids[lo + t].as_py(), matcher.items[i][0], a, b, edits, 1 - edits / len(matcher.strings[i])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [ids.type, item_type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "first_word", "after_word", "edits", "similarity"])

    return run


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose id contains no item. Rows with a null id are judged by their id, too."""
    hit = written(contaminated(documents, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__hit")).distinct(), "leaks")
    go = maybe_broadcast(hit)
    return documents.join(go, documents[id_col].eqNullSafe(go["__hit"]), "left_anti")
