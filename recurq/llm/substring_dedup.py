"""Near-duplicate passages by compact windows over shingle min-hashes.

Texts are folded words in shingles of ``SHINGLE`` words. For one hash function, a position and the longest
run around it in which its hash is the least form a compact window; every passage in the window that
contains the position has that min-hash. Windows are the nodes of the Cartesian tree over the hashes;
those that hold a passage of ``least_words`` are the positions that are the minimum of some run of that
length, which sliding minima find without building the tree.

A passage's window is met from either side of its centre: any passage long enough contains the whole
half-length stretch before the centre, or the one after it. The key of a side joins the min-hash to a
second min-hash over that stretch, so a common phrase in different surroundings does not make a group.
Keys that occur once are dropped by a Bloom filter of bounded size. Members of a key are joined to its least
member, never to each other; what is left over because
it does not verify against that member is keyed again and joined anew: by the min-hashes of all passages of
full length around the centre and by the short stretches beside it, for near copies, and by hashes of those passages as a
whole, for exact repeats. Members of a whole passage are equal, so any of them verifies against the least, and no exact repeat
is lost to a stranger. The members that did verify take part too, as a repeat can join them to one that did
not. Whole passages are keyed only where a half-length stretch at the centre repeats.

Keys travel in bundles, the keys of some documents that fall into one of 2 ** ``_PARTS`` ranges, each key once a bundle, so
Spark moves and sorts bundles, not keys. Only the least member in a bundle goes to the range of a key, and the least
of all comes back to the documents of the bundle; so a key that occurs everywhere brings a row a bundle to one task.

Verification joins the shingles of two documents and asks for two passages of ``least_words`` at the
anchor with a Jaccard similarity of ``similarity`` or more, as multisets; an edited passage shares each of ``functions``
min-hashes with that probability. Verified passages are extended along equal shingles, as far as
the two documents share them, and overlapping ones of a document merge.

Cases: null, empty and short texts have no passage; rows of one id are one document, and a passage that
repeats within one document only is not reported; ids that are null are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_path, maybe_broadcast, written, written_at
from .wordhash import blocks, buffers, mix, shingles, words

SHINGLE = 5
_FILTER_BITS = 27
#: Places in a stretch beside an anchor.
_FLANK = 4
#: Tiles that are compared at once, and about as many anchors of whole pairs that are verified at once: they bound a task's memory.
_TILES, _ANCHORS = 1 << 12, 1 << 16
#: Shingles of whole documents, and anchors among them, that are keyed again at once.
_SHINGLES, _LEFT = 1 << 18, 1 << 12
#: A tile's places fall into 2 ** ``_CELL_BITS`` cells where tiles are sorted out before they are compared in full.
_CELL_BITS = 10
#: Keys that a task bundles at once, about, and the upper bits of a key that make its range.
_BUNDLE, _PARTS = 1 << 18, 11


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width``; one for each start."""
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def centres(x: np.ndarray, width: int) -> np.ndarray:
    """Positions whose compact window holds ``width`` elements: those that are the least of some run of that length."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    least = sliding_min(x, width)
    # the largest of the minima of the runs that contain a position is its own value where it is a minimum
    edge = ~np.zeros(width - 1, np.uint64)
    largest = ~sliding_min(np.concatenate((edge, ~least, edge)), width)
    return np.flatnonzero(largest == x)


def keys_of(h: np.ndarray, at: np.ndarray, width: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, centre) of the windows of several texts. ``at`` has the places where texts begin, and the end."""
    half = (width - 1) // 2
    keys, where = [], []
    n = len(h)
    owner_first, owner_last = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
    with np.errstate(over="ignore"):
        second = mix(h * np.uint64(0xD6E8FEB86659FD93))
        stretch = sliding_min(second, half) if n >= half else np.zeros(0, np.uint64)
        for f in range(functions):
            x = mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(f + 1))
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a >= width:
                    found.append(centres(x[a:b], width) + a)
            if not found:
                continue
            c = np.concatenate(found)
            before, after = c[c - half >= owner_first[c]], c[c + half < owner_last[c]]
            keys += [mix(x[before] ^ mix(stretch[before - half] + np.uint64(1))), mix(x[after] ^ mix(stretch[after + 1] + np.uint64(2)))]
            where += [before, after]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(where)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _binary(numbers: np.ndarray, bounds: np.ndarray | None = None) -> pa.Array:
    """Binaries of the numbers between ``bounds``, or one of all."""
    bounds = np.array([0, len(numbers)]) if bounds is None else bounds
    offsets = (bounds * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binaries, one after the other, and where each binary's begin, and the end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data else np.zeros(0, kind)
    return flat, (ends - ends[0]) // np.dtype(kind).itemsize


def _in_parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of sorted keys, and where the keys of each begin, and the end."""
    part = (key >> np.uint64(64 - _PARTS)).astype(np.int32)
    first = _starts(part)
    return part[first], np.append(first, len(part))


def _together(bundles: DataFrame) -> DataFrame:
    """Bundles of a range in one task, ranges in order."""
    return bundles.repartition("part").sortWithinPartitions("part")


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_together`` regrouped so that no range is in two batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        cut = int(np.searchsorted(part, part[-1]))
        if cut or held and held[-1].column(0)[0].as_py() != part[0]:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _gathered(found: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Some of ``found`` at a time, about ``_BUNDLE`` keys; the keys are the first of each."""
    some, n = [], 0
    for one in found:
        some.append(one)
        n += len(one[0])
        if n >= _BUNDLE:
            yield some
            some, n = [], 0
    if n:
        yield some


def _once_each(found: Iterator[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
    """Bundles (part, h, flags) of keys and whether they are around an anchor that is left, where given: flag 1 for a key that
    occurs twice in the bundle, 2 for one that is around such an anchor or may be."""
    for some in _gathered(found):
        key = np.concatenate([k for k, _ in some])
        flag = np.concatenate([np.full(len(k), 2, np.uint8) if left is None else left.astype(np.uint8) * np.uint8(2) for k, left in some])
        order = np.argsort(key)
        key, flag = key[order], flag[order]
        first = _starts(key)
        flag = np.bitwise_or.reduceat(flag, first) | (np.diff(np.append(first, len(key))) > 1).astype(np.uint8)
        part, bounds = _in_parts(key[first])
        yield pa.RecordBatch.from_arrays([pa.array(part), _binary(key[first], bounds), _binary(flag, bounds)], names=["part", "h", "flags"])


def _bits(key: np.ndarray) -> np.ndarray:
    """Three bits of a word of the filter, selected by the lower 18 bits of a key."""
    one = np.uint64(1)
    return (one << (key & np.uint64(63))) | (one << (key >> np.uint64(6) & np.uint64(63))) | (one << (key >> np.uint64(12) & np.uint64(63)))


def _repeated(bundles: DataFrame) -> np.ndarray:
    """The filter of keys that occur at least twice, once around an anchor that is left, from ``_once_each``: one array of 2**(_FILTER_BITS - 6)
    words, its size whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_parts(batches):
            (key, _), (flag, _) = _numbers(batch.column(1), np.uint64), _numbers(batch.column(2), np.uint8)
            order = np.argsort(key)
            key, first = key[order], _starts(key[order])
            flag = np.bitwise_or.reduceat(flag[order], first) | (np.diff(np.append(first, len(key))) > 1).astype(np.uint8)
            key = key[first[flag == 3]]
            if len(key):
                word = (key >> np.uint64(64 - (_FILTER_BITS - 6))).astype(np.int32)
                first = _starts(word)
                yield pa.RecordBatch.from_arrays([_binary(word[first]), _binary(np.bitwise_or.reduceat(_bits(key), first))], names=["words", "bits"])

    out = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    for batch in _together(bundles).mapInArrow(run, "words binary, bits binary").toArrow().to_batches():
        out[_numbers(batch.column(0), np.int32)[0]] = _numbers(batch.column(1), np.uint64)[0]
    return out


_WINDOWS = "bundle long, keys binary, least binary, least_centre binary, starts binary, docs binary, doc binary, centre binary"


def _rank(doc: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Order of the members of a key: by a fixed hash of the document, so that one document is the least of all keys of a group, then by place."""
    return ((doc & np.int64((1 << 39) - 1)) << np.int64(24)) | np.minimum(centre, (1 << 24) - 1).astype(np.int64)


def _windows(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One bundle a row of (key, document, centre): the keys, each once, their least members, and all members, by key."""
    for k, some in enumerate(_gathered(found)):
        key, doc, centre = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((_rank(doc, centre), key))
        key, doc, centre = key[order], doc[order], centre[order].astype(np.int32)
        first = _starts(key)
        docs, which = np.unique(doc, return_inverse=True)
        columns = [key[first], doc[first], centre[first], first.astype(np.int32), docs, which.astype(np.int32), centre]
        yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()), *map(_binary, columns)], names=[x.split()[0] for x in _WINDOWS.split(", ")])


def _scan(source: DataFrame, width: int, functions: int, dense=None) -> DataFrame:
    """``_windows`` of the source, or ``_once_each`` of their keys without ``dense``, the filter of repeated keys."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in blocks(offsets):
                some = words(data, offsets, lo, hi)
                h, at = shingles(some.hashes, some.first, SHINGLE)
                key, centre = keys_of(h, at, width, functions)
                if dense is None:
                    yield key, None
                    continue
                hit = _in_filter(dense.value, key)
                key, centre = key[hit], centre[hit]
                text = np.searchsorted(at, centre, "right") - 1
                yield key, ids[lo + text], centre - at[text]

    columns = source.select("doc_id", "text")
    if dense is None:
        return columns.mapInArrow(lambda batches: _once_each(found(batches)), "part int, h binary, flags binary")
    return columns.mapInArrow(lambda batches: _windows(found(batches)), _WINDOWS)


def _in_filter(dense: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the filter has each key."""
    bits = _bits(key)
    return (dense[key >> np.uint64(64 - (_FILTER_BITS - 6))] & bits) == bits


def least_common(width: int, similarity: float) -> float:
    """How many places two passages of ``width`` must have in common."""
    return 2 * width * similarity / (1 + similarity) - 1e-9


class Sides:
    """Shingles of the two documents of several pairs, one after the other: ``flat[start[k]:start[k] + size[k]]`` are those of pair ``k``."""

    def __init__(self, arrays: list[np.ndarray] | pa.Array):
        if isinstance(arrays, list):
            self.flat, self.size = np.concatenate(arrays), np.array([len(x) for x in arrays], np.int64)
            self.start = np.cumsum(self.size) - self.size
        else:
            _, offsets, data = arrays.buffers()
            bounds = np.frombuffer(offsets, np.int32)[arrays.offset : arrays.offset + len(arrays) + 1].astype(np.int64) // 4
            self.flat, self.start, self.size = np.frombuffer(data, np.uint8).view(np.uint32) if data else np.zeros(0, np.uint32), bounds[:-1], np.diff(bounds)

    def at(self, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The shingles of pairs (one a row) at places, wherever they are inside."""
        return self.flat[np.clip(self.start[pair][:, None] + place, 0, max(0, len(self.flat) - 1))]


def shared_passages(a: Sides, b: Sides, pair: np.ndarray, c: np.ndarray, o: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages that pairs of documents share around anchors (c, o): rows (pair, from, to, from, to), their similarity, and which anchors are in none.

    Similarity is the Jaccard of multisets. A tile is a run of ``width`` places where passages begin, at one shift; it is
    tried once for all anchors near it. Places that are equal along a diagonal are common to both, so most
    anchors are settled by a running count of equal places. One that is not can only be in a passage with an
    insertion or deletion: the equal places in the square of two passages are counted then.
    """
    shift = o - c
    tile, twice = np.concatenate(((c - width + 1) // width, c // width)), np.tile(np.arange(len(c)), 2)
    order = np.lexsort((tile, shift[twice], pair[twice]))
    t, s, p = tile[order], shift[twice][order], pair[twice][order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1]))) if len(t) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    before, after = of[: len(c)], of[len(c) :]
    t, s, p = t[new] * width, s[new], p[new]
    left_out = np.ones(len(c), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step, count in ((_TILES, _on_diagonals), (128, _in_squares)):
        wanted = np.zeros(len(t), bool)
        wanted[before[left_out]] = wanted[after[left_out]] = True
        wanted = np.flatnonzero(wanted)
        if count is _in_squares:
            parts = [wanted[k : k + _TILES] for k in range(0, len(wanted), _TILES)]
            wanted = np.concatenate([wanted[:0], *(at[_may_hold(a, b, p[at], t[at], s[at], width, similarity)] for at in parts)])
        good = np.zeros((len(t), width + 1), np.int16)
        rows = []
        for k in range(0, len(wanted), step):
            at = wanted[k : k + step]
            common, in_a, in_b = count(a, b, p[at], t[at], s[at], width, similarity)
            enough = common >= least_common(width, similarity)
            good[at, 1:] = np.cumsum(enough, axis=1)
            some = np.flatnonzero(enough.any(axis=1))
            rows.append((at[some], *_ends(common[some], enough[some], in_a[some], in_b[some])))
        found += _runs(rows, p, t, s, width)
        open_at = np.flatnonzero(left_out)
        one, two, at = before[open_at], after[open_at], c[open_at]
        settled = (good[one, width] > good[one, at - width + 1 - t[one]]) | (good[two, at - t[two] + 1] > 0)
        left_out[open_at[settled]] = False
    places = np.concatenate([x for x, _ in found]) if found else np.zeros((0, 5), np.int64)
    return places, np.concatenate([x for _, x in found]) if found else np.zeros(0), left_out


def _inside(a: Sides, b: Sides, p: np.ndarray, lo: np.ndarray, s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tiles of a, which of them both documents have, and which of their passages."""
    place = lo[:, None] + np.arange(2 * width - 1)
    first, last = np.maximum(0, -s)[:, None], np.minimum(a.size[p], b.size[p] - s)[:, None]
    return place, (place >= first) & (place < last), (place[:, :width] >= first) & (place[:, :width] + width <= last)


def _on_diagonals(a: Sides, b: Sides, p: np.ndarray, lo: np.ndarray, s: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tile what the passages that begin there have equal, place by place, and which places of a and of b are equal."""
    place, inside, whole = _inside(a, b, p, lo, s, width)
    equal = (a.at(p, place) == b.at(p, place + s[:, None])) & inside
    sums = np.zeros((len(p), 2 * width), np.int16)
    np.cumsum(equal, axis=1, out=sums[:, 1:])
    return np.where(whole, sums[:, width:] - sums[:, :width], 0), equal, equal


def _in_squares(a: Sides, b: Sides, p: np.ndarray, lo: np.ndarray, s: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tile what the passages that begin there have in common as multisets, exact where that is enough, and which places of a and of b occur in the other.

    Equal places in the square of two passages bound it; they are it where no shingle repeats in the tile.
    """
    need = least_common(width, similarity)
    place, inside, whole = _inside(a, b, p, lo, s, width)
    x, y = a.at(p, place), b.at(p, place + s[:, None])
    equal = x[:, :, None] == y[:, None, :]
    equal &= inside[:, :, None] & inside[:, None, :]
    in_a, in_b = equal.any(axis=2), equal.any(axis=1)
    most = np.zeros((2, len(p), 2 * width), np.int16)
    np.cumsum(in_a, axis=1, out=most[0, :, 1:])
    np.cumsum(in_b, axis=1, out=most[1, :, 1:])
    most = np.where(whole, (most[:, :, width:] - most[:, :, :width]).min(axis=0), 0)
    some = np.flatnonzero((most >= need).any(axis=1))
    common = np.zeros((len(p), width), np.int64)
    if len(some):
        k = np.arange(width)
        sums = np.zeros((len(some), 2 * width, 2 * width), np.int16)
        np.cumsum(np.cumsum(equal[some], axis=1, dtype=np.int16), axis=2, dtype=np.int16, out=sums[:, 1:, 1:])
        box = sums[:, k + width, k + width] - sums[:, k, k + width] - sums[:, k + width, k] + sums[:, k, k]
        box = np.minimum(box, most[some])
        repeats = (equal[some].sum(axis=1) > 1).any(axis=1) | (equal[some].sum(axis=2) > 1).any(axis=1)
        again = np.argwhere(repeats[:, None] & (box >= need))
        for u in range(0, len(again), 4096):
            t, at = again[u : u + 4096].T
            at_places = at[:, None] + k
            box[t, at] = multiset_common(x[some[t][:, None], at_places].astype(np.int64), y[some[t][:, None], at_places].astype(np.int64))
        common[some] = box
    return common, in_a, in_b


def _may_hold(a: Sides, b: Sides, p: np.ndarray, lo: np.ndarray, s: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Whether some passage of each tile may have enough in common: at most its places whose cell, of a few by the hash, has a place of the other."""
    place, inside, whole = _inside(a, b, p, lo, s, width)
    row, drop = np.arange(len(p))[:, None] << _CELL_BITS, np.uint32(32 - _CELL_BITS)
    x, y = row + (a.at(p, place) >> drop), row + (b.at(p, place + s[:, None]) >> drop)
    may = whole
    for here, there in ((x, y), (y, x)):
        cells = np.zeros(len(p) << _CELL_BITS, bool)
        cells[there[inside]] = True
        sums = np.zeros((len(p), 2 * width), np.int16)
        np.cumsum(cells[here] & inside, axis=1, out=sums[:, 1:])
        may = may & (sums[:, width:] - sums[:, :width] >= least_common(width, similarity))
    return may.any(axis=1)


def _ends(common: np.ndarray, enough: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What runs need of each tile, a few numbers: its first and its last passage, where they begin and end in a and in b without the
    outer places that are in one document only (first, last, begin, end, begin, end); and the most that a passage has in common."""
    width, places = enough.shape[1], np.arange(in_a.shape[1])
    first, last = enough.argmax(axis=1), width - 1 - enough[:, ::-1].argmax(axis=1)
    from_first, to_last = places >= first[:, None], places < (last + width)[:, None]
    out = [first, last]
    for here in (in_a, in_b):
        out += [(here & from_first).argmax(axis=1), len(places) - (here & to_last)[:, ::-1].argmax(axis=1)]
    return np.stack(out, axis=1), np.where(enough, common, 0).max(axis=1, initial=0).astype(np.int64)


def _runs(rows: list[tuple], p: np.ndarray, lo: np.ndarray, s: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows (pair, from, to, from, to), and similarity, of the runs of passages that join, from the ``_ends`` of tiles. Passages of one tile always join."""
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return []
    tile, ends, most = (np.concatenate(x) for x in zip(*rows, strict=True))
    pair, shift, at = p[tile], s[tile], lo[tile]
    gap = at[1:] + ends[1:, 0] - at[:-1] - ends[:-1, 1]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1]) | (gap > width))))
    last = np.concatenate((first[1:], [len(tile)])) - 1
    most = np.maximum.reduceat(most, first)
    out = [pair[first]]
    for k, by in ((2, 0), (4, shift[first])):
        out += [at[first] + ends[first, k] + by, at[last] + ends[last, k + 1] + by]
    return [(np.stack(out, axis=1), most / (2 * width - most))]


def multiset_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the rows of ``x`` and ``y`` have in common, as multisets."""

    def numbered(z: np.ndarray) -> np.ndarray:
        z = np.sort(z, axis=1)
        new = np.concatenate((np.ones((len(z), 1), bool), z[:, 1:] != z[:, :-1]), axis=1)
        place = np.arange(z.shape[1])
        return z * (2 * z.shape[1]) + (place - np.maximum.accumulate(np.where(new, place, 0), axis=1))

    both = np.sort(np.concatenate((numbered(x), numbered(y)), axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1)


def passages(a: np.ndarray, b: np.ndarray, c: np.ndarray, o: np.ndarray, width: int, similarity: float) -> tuple[list[tuple], np.ndarray]:
    """``shared_passages`` of one pair: (from, to) in both documents and similarity; and which anchors are in none."""
    places, similar, left_out = shared_passages(Sides([a]), Sides([b]), np.zeros(len(c), np.int64), c, o, width, similarity)
    return [(*x[1:], y) for x, y in zip(places.tolist(), similar.tolist(), strict=True)], left_out


def _once(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of numbers, in order and each of them once."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _verify(pairs: DataFrame, arrays: DataFrame, width: int, similarity: float, anchors: bool = False) -> DataFrame:
    """Both sides of every verified passage, kind 0; and with ``anchors`` those of each document of a batch, kind 1, as
    numbers of 64 bits: twice the place, and one if the anchor is left over."""
    id_type = arrays.schema["id"].dataType.simpleString()
    left = arrays.select("doc_id", "id", F.col("shingles").alias("a"))
    right = arrays.select(F.col("doc_id").alias("other"), F.col("id").alias("other_id"), F.col("shingles").alias("b"))
    both = pairs.join(left.hint("merge"), "doc_id").join(right.hint("merge"), "other").select("doc_id", "other", "anchors", "a", "b", "id", "other_id")
    columns = ["kind", "doc_id", "id", "first_word", "after_word", "other", "similarity", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks, offsets = _numbers(batch.column(2), np.int64)
            names = ((batch.column(0), batch.column(5)), (batch.column(1), batch.column(6)))
            seen = []
            for lo, hi in blocks(offsets, _ANCHORS):
                part = batch.slice(lo, hi - lo)
                # an anchor may come from several bundles
                pair, both = _once(np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), marks[offsets[lo] : offsets[hi]])
                c, o = both >> 32, both & 0xFFFFFFFF
                found, similar, left_out = shared_passages(Sides(part.column(3)), Sides(part.column(4)), pair, c, o, width, similarity)
                which, similar = pa.array(found[:, 0] + lo), pa.array(similar)
                for (one, two), at in ((names, 1), (names[::-1], 3)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int32)), one[0].take(which), one[1].take(which), pa.array(found[:, at]), pa.array(found[:, at + 1] + SHINGLE - 1), two[1].take(which), similar, pa.nulls(len(found), pa.binary())], names=columns)
                seen.append((pair + lo, c, o, left_out))
            if not anchors:
                continue
            # the anchors of each document of the batch, and which of them are left over
            pair, c, o, left_out = (np.concatenate(x) for x in zip(*seen, strict=True))
            for (one, name), at in ((names[0], c), (names[1], o)):
                _, first, document = np.unique(one.to_numpy(), return_index=True, return_inverse=True)
                owner, marked = _once(document[pair], at * 2 + left_out)
                bounds = np.searchsorted(owner, np.arange(len(first) + 1))
                places = pa.array([marked[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), np.int32)), one.take(pa.array(first)), name.take(pa.array(first)), none, none, name.take(pa.array(first)), pa.nulls(len(first), pa.float64()), places], names=columns)

    return both.mapInArrow(run, f"kind int, doc_id long, id {id_type}, first_word long, after_word long, other {id_type}, similarity double, places binary")


def _pairs(hits: DataFrame, spread: bool = False) -> DataFrame:
    """Each member of a key with the key's least member, one row for a pair of documents with its anchors, place in one and in the other, each once.

    ``hits`` is a written table of ``_windows``. The least members of bundles meet by key; the least of all goes back to each bundle.
    A document is in one bundle, or with ``spread`` in several, whose anchors are then put together.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, doc, centre = (_numbers(batch.column(k).slice(row, 1), kind)[0] for k, kind in ((1, np.uint64), (2, np.int64), (3, np.int32)))
                part, bounds = _in_parts(key)
                bundle = pa.array(np.full(len(part), batch.column(0)[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part), bundle, _binary(key, bounds), _binary(doc, bounds), _binary(centre, bounds)], names=["part", "bundle", "keys", "doc", "centre"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_parts(batches):
            key, bounds = _numbers(batch.column(2), np.uint64)
            (doc, _), (centre, _) = _numbers(batch.column(3), np.int64), _numbers(batch.column(4), np.int32)
            order = np.lexsort((_rank(doc, centre), key))
            first = _starts(key[order])
            of = np.empty(len(key), np.int64)
            of[order] = np.repeat(order[first], np.diff(np.append(first, len(key))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), _binary(doc[of], bounds), _binary(centre[of], bounds)], names=["bundle", "part", "other", "m"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                starts, docs, which, centre = (_numbers(batch.column(k).slice(row, 1), kind)[0] for k, kind in ((1, np.int32), (2, np.int64), (3, np.int32), (4, np.int32)))
                back = batch.column(5).slice(row, 1).flatten()
                back = back.take(pa.array(np.argsort(back.field("part").to_numpy())))
                sizes = np.diff(np.append(starts, len(which)))
                other, m = (np.repeat(_numbers(back.field(name), kind)[0], sizes) for name, kind in (("other", np.int64), ("m", np.int32)))
                pair = np.flatnonzero(docs[which] != other)
                which, other, anchor = which[pair], other[pair], (centre[pair].astype(np.int64) << 32) | m[pair]
                order = np.lexsort((anchor, other, which))
                which, other, anchor = which[order], other[order], anchor[order]
                # an anchor that several keys make is one
                new = np.ones(len(which), bool)
                new[1:] = (which[1:] != which[:-1]) | (other[1:] != other[:-1]) | (anchor[1:] != anchor[:-1])
                which, other, anchor = which[new], other[new], anchor[new]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(which)), bool), (which[1:] != which[:-1]) | (other[1:] != other[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(docs[which[first]]), pa.array(other[first]), _binary(anchor, np.append(first, len(which)))], names=["doc_id", "other", "anchors"])

    sent = hits.select("bundle", "keys", "least", "least_centre").mapInArrow(out, "part int, bundle long, keys binary, doc binary, centre binary")
    back = _together(sent).mapInArrow(least, "bundle long, part int, other binary, m binary")
    back = back.groupBy("bundle").agg(F.collect_list(F.struct("part", "other", "m")).alias("back"))
    pairs = hits.select("bundle", "starts", "docs", "doc", "centre").join(back.hint("merge"), "bundle").mapInArrow(joined, "doc_id long, other long, anchors binary")
    if not spread:
        return pairs
    one = F.aggregate("anchors", F.lit(b""), lambda x, y: F.concat(x, y))
    return pairs.groupBy("doc_id", "other").agg(F.collect_list("anchors").alias("anchors")).select("doc_id", "other", one.alias("anchors"))


def _arrays(source: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingles, 32 bits each, of the documents in ``ids``, once each."""
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out = []
            for lo, hi in blocks(offsets):
                found = words(data, offsets, lo, hi)
                h, at = shingles(found.hashes, found.first, SHINGLE)
                low = (h >> np.uint64(32)).astype(np.uint32)
                out += [low[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "id", "shingles"])

    wanted = source.join(maybe_broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "id")
    return wanted.mapInArrow(run, f"doc_id long, id {id_type}, shingles binary")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, id) of every document once; doc_id is a number of the id and the text, as an id may stand for several texts."""
    text = F.col(text_col).cast("string")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias("of"), text.alias("text"))
    for seed in itertools.count():
        source = rows.withColumn("doc_id", F.xxhash64("of", *[F.lit(seed)] * (seed > 0)))
        # rows that repeat, id and text, are rare, so only they are brought together
        repeated = written(source.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-rows")
        if repeated.isEmpty():
            return source.select("doc_id", "text", F.col("of.id").alias("id"))
        again = maybe_broadcast(repeated)
        once = source.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "of"])
        if once.groupBy("doc_id").count().filter("count > 1").isEmpty():  # else two documents have one number: numbers anew
            return source.join(again, "doc_id", "left_anti").unionByName(once).select("doc_id", "text", F.col("of.id").alias("id"))


def _around(anchors: DataFrame, arrays: DataFrame) -> DataFrame:
    """Each document with its anchors, as ``_verify`` gives them for a batch, and its shingles."""
    return anchors.groupBy("doc_id").agg(F.collect_list("places").alias("places")).join(arrays.hint("merge"), "doc_id").select("doc_id", "places", "shingles", "id")


def _anchored(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows of ``_around`` at a time: ids, the shingles one after the other and where each document's begin (as ``first`` of words), and
    of the anchors, each once, document, place in all shingles and whether it is left over somewhere."""
    sizes = np.concatenate(([0], np.cumsum(Sides(batch.column(2)).size)))
    for lo, hi in blocks(sizes, _SHINGLES):
        part = batch.slice(lo, hi - lo)
        side, lists = Sides(part.column(2)), part.column(1)
        h, at = side.flat[side.start[0] : side.start[0] + side.size.sum()].astype(np.uint64), sizes[lo : hi + 1] - sizes[lo]
        marks, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        _, offsets, data = marks.buffers()
        ends = np.frombuffer(offsets, np.int32)[marks.offset : marks.offset + len(marks) + 1].astype(np.int64)
        codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64)
        ends = (ends[bounds - bounds[0]] - ends[0]) // 8
        owner, codes = _once(np.repeat(np.arange(hi - lo), np.diff(ends)), codes)
        place = codes >> 1
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))))
        owner = owner[first]
        yield part.column(0), h, at, owner, place[first] + at[owner], np.maximum.reduceat(codes & 1, first).astype(bool)


def passage_minima(h: np.ndarray, first: np.ndarray, last: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, centre) of the min-hashes of every passage of full length around anchors, whose texts are from ``first`` to ``last``."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = sliding_min(mix(h + np.uint64(1)), width)
    # neighbouring passages mostly share their min-hash, so there are a few keys for an anchor
    starts = c[:, None] + np.arange(1 - width, 1)
    new = (starts >= first[:, None]) & (starts <= last[:, None] - width)
    values = least[np.clip(starts, 0, len(least) - 1)]
    new[:, 1:] &= (values[:, 1:] != values[:, :-1]) | ~new[:, :-1]
    row, column = np.nonzero(new)
    return mix(values[row, column] ^ mix(h[c])[row]), c[row]


def flank_keys(h: np.ndarray, c: np.ndarray, width: int, dense: np.ndarray | None = None, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, centre) of the short stretches beside anchors, each by its least hash, as far as a passage with the anchor reaches.

    Documents that share only a line around the anchor agree in the stretches of the line; two that share more agree in one
    beyond it, too, an insertion or deletion between them or not. With ``dense``, the filter of repeated keys, those that
    repeat: all of them, as outer ones may repeat in other documents than the near copy. Anchors' texts are from ``first`` to ``last``, or all of ``h``.
    """
    if len(h) < _FLANK or not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = sliding_min(mix(h + np.uint64(5)), _FLANK)
    away = np.arange(1, width - _FLANK + 1, _FLANK)
    start = c[:, None] + np.concatenate((away, 1 - _FLANK - away))
    some = (start >= np.reshape(first, (-1, 1))) & (start <= np.reshape(len(h) if last is None else last, (-1, 1)) - _FLANK)
    with np.errstate(over="ignore"):
        key = mix(mix(least[np.where(some, start, 0)] + np.uint64(3)) ^ h[c][:, None])
    if dense is not None:
        some &= _in_filter(dense, key)
    return key[some], c[np.nonzero(some)[0]]


def _near(around: DataFrame, width: int, dense=None) -> DataFrame:
    """``_windows`` of ``passage_minima`` and ``flank_keys`` of the anchors that are left, or without ``dense``, the
    filter of repeated keys of flanks, ``_once_each`` of the flanks alone."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for ids, h, at, owner, places, left in _anchored(batch):
                ids, owner, places = ids.to_numpy(), owner[left], places[left]
                for k in range(0, len(places), _LEFT):
                    c, first, last = places[k : k + _LEFT], at[owner[k : k + _LEFT]], at[owner[k : k + _LEFT] + 1]
                    key, centre = flank_keys(h, c, width, None if dense is None else dense.value, first, last)
                    if dense is None:
                        yield key, None
                        continue
                    key, centre = (np.concatenate(x) for x in zip((key, centre), passage_minima(h, first, last, c, width), strict=True))
                    text = np.searchsorted(at, centre, "right") - 1
                    yield key, ids[text], centre - at[text]

    if dense is None:
        return around.mapInArrow(lambda batches: _once_each(found(batches)), "part int, h binary, flags binary")
    return around.mapInArrow(lambda batches: _windows(found(batches)), _WINDOWS)


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width``, one for each start; equal for equal runs wherever they are."""
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        span, out = 1, mix(h + one)
        while span * 2 <= width:
            out = mix(out[:-span] * one + out[span:])
            span *= 2
        rest = width - span
        return mix(out[: max(0, len(out) - rest)] * two + out[rest:]) if rest else out


def stretch_keys(h: np.ndarray, first: np.ndarray, last: np.ndarray, c: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, which anchors have it) of the half-length stretches that end and that begin at anchors. Any passage
    of ``width`` that contains an anchor contains one of its stretches."""
    half = (width - 1) // 2
    whole = run_hashes(h, half + 1)
    before, after = np.flatnonzero(c - half >= first), np.flatnonzero(c + half < last)
    with np.errstate(over="ignore"):
        return [(mix(whole[c[before] - half] + np.uint64(1)), before), (mix(whole[c[after]] + np.uint64(2)), after)]


def passage_keys(h: np.ndarray, first: np.ndarray, last: np.ndarray, c: np.ndarray, left: np.ndarray, width: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, around an anchor that is left) of the whole passages that hold an anchor and a stretch of it that ``dense`` has."""
    half = (width - 1) // 2
    marks = np.zeros((2, len(h) + 1), np.int64)
    for (key, which), low, high in zip(stretch_keys(h, first, last, c, width), (1 - width, half + 1 - width), (-half, 0), strict=True):
        which = which[_in_filter(dense, key)]
        start, end = np.maximum(c[which] + low, first[which]), np.minimum(c[which] + high, last[which] - width)
        for row, chosen in enumerate((start <= end, (start <= end) & left[which])):
            np.add.at(marks[row], start[chosen], 1)
            np.add.at(marks[row], end[chosen] + 1, -1)
    on, by_left = np.cumsum(marks, axis=1)[:, :-1] > 0
    starts = np.flatnonzero(on)
    return run_hashes(h, width)[starts], starts, by_left[starts]


def _whole(around: DataFrame, width: int) -> DataFrame:
    """``_windows`` of the passages of full length around anchors that occur, as they are, at least twice; centre is the start."""
    spark = around.sparkSession

    def scan(stretches, passages) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for ids, h, at, owner, c, left in _anchored(batch):
                    if stretches is None:
                        for key, which in stretch_keys(h, at[owner], at[owner + 1], c, width):
                            yield key, left[which]
                        continue
                    key, start, by_left = passage_keys(h, at[owner], at[owner + 1], c, left, width, stretches.value)
                    if passages is None:
                        yield key, by_left
                        continue
                    hit = _in_filter(passages.value, key)
                    key, start = key[hit], start[hit]
                    text = np.searchsorted(at, start, "right") - 1
                    yield key, ids.to_numpy()[text], start - at[text]

        if passages is None:
            return around.mapInArrow(lambda batches: _once_each(found(batches)), "part int, h binary, flags binary")
        return around.mapInArrow(lambda batches: _windows(found(batches)), _WINDOWS)

    stretches = spark.sparkContext.broadcast(_repeated(scan(None, None)))
    return scan(stretches, spark.sparkContext.broadcast(_repeated(scan(stretches, None))))


def repeated_passages(df: DataFrame, least_words: int = 50, similarity: float = 0.8, functions: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage of a document that repeats, nearly, in another: doc_id, first_word, after_word,
    other_id (the least document it was found in), similarity (the best)."""
    spark = df.sparkSession
    width = least_words - SHINGLE + 1
    source = _numbered(df, id_col, text_col)
    dense = spark.sparkContext.broadcast(_repeated(_scan(source, width, functions)))
    hits, hits_path = written_at(_scan(source, width, functions, dense), "windows")
    pairs, pairs_path = written_at(_pairs(hits), "pairs")
    drop_path(spark, hits_path)
    ids = written(pairs.select("doc_id").unionAll(pairs.select("other")).distinct(), "ids")
    arrays, arrays_path = written_at(_arrays(source, ids), "shingles")
    first = written(_verify(pairs, arrays, width, similarity, anchors=True), "verified")
    found = first.filter("kind = 0")
    around = written(_around(first.filter("kind = 1"), arrays), "around")
    drop_path(spark, pairs_path)
    drop_path(spark, arrays_path)
    flanks = spark.sparkContext.broadcast(_repeated(_near(around, width)))
    rekeyed, rekeyed_path = written_at(_near(around, width, flanks).unionAll(_whole(around, width)), "windows")
    again = written(_pairs(rekeyed, spread=True), "pairs")
    drop_path(spark, rekeyed_path)
    second = _verify(again, around.select("doc_id", "id", "shingles"), width, similarity).filter("kind = 0")
    passages = found.unionAll(second).groupBy("doc_id", "first_word", "after_word").agg(F.first("id").alias("id"), F.min("other").alias("other"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy("doc_id").orderBy("first_word", "after_word")
    reach = F.max("after_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = passages.withColumn("island", F.sum(F.when(reach >= F.col("first_word"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.first("id").alias("id"), F.min("first_word").alias("first_word"), F.max("after_word").alias("after_word"), F.min("other").alias("other"), F.max("similarity").alias("similarity"))
    return merged.select("id", "first_word", "after_word", "other", "similarity").toDF("doc_id", "first_word", "after_word", "other_id", "similarity")
