"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text is its characters with a space before them. An agenda holds the adjacent pairs of symbols that are
pieces; the pair of the best score, the leftmost of equal ones, is merged until none is left. What is no
piece then becomes its UTF-8 bytes. No merge crosses from a character to a space, so the words of a block of
texts have an agenda each, and all of those take their best pair in one step of array operations; a very long
word has a heap. A worker remembers ``memo_entries`` words at most and begins anew beyond, which costs time
and changes no result.

In each Arrow batch every ``check_every``-th text is encoded and decoded by the sentencepiece library, too; a
difference is an error. Nothing shuffles, so no key can be hot.

Cases: a null or empty text has the begin and end ids only and decodes to an empty text; spaces are kept,
U+2581 counts as a space and decodes as one; strings such as ``</s>`` in a text are ordinary text; repeated
rows are encoded each; extra columns are ignored; a model of another type, or with a normalizer, is an error.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_NEVER = np.iinfo(np.int32).max
_encoders: dict[tuple, "Encoder"] = {}


def _slices(data: bytes, ends: np.ndarray) -> list[bytes]:
    at = [0, *ends.tolist()]
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """Encodes and decodes as the model in the file ``path`` does."""

    def __init__(self, path: str, memo_entries: int = 800_000, memo_chars: int = 64, array_chars: int = 200):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        kinds, normal = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec
        plain = normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError(f"{path}: no merge-type model with byte fallback and without a normalizer")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) or re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces if p.type != kinds.CONTROL):
            raise ValueError(f"{path}: pieces that the user defined, that are unused or that cross words")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = (struct.pack("<I", i) for i in (self.library.bos_id(), self.library.eos_id()))
        self._id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        # equal scores have equal ranks: the leftmost pair goes first
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._rank = {p: order[s] for p, s in scores.items()}
        self._byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self._byte_ids[int(p.piece[1:-1], 16)] = i
        # symbols: ids of pieces, and beyond them the code points of characters that are none
        self._beyond = len(proto.pieces)
        self._symbol_of = np.arange(0x110000, dtype=np.int32) + self._beyond
        for p, i in self._id.items():
            if len(p) == 1:
                self._symbol_of[ord(p)] = i
        self._symbol_of[ord(" ")] = self._symbol_of[ord(SPACE)]
        self._pairs(scores)
        shown = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" for p in proto.pieces]
        self._shown, self._shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self._shown_at = np.cumsum(self._shown_size) - self._shown_size
        self._spaced = re.compile(" +[^ ]*")
        self._words: dict[str, bytes] = {}  # a word to the ids of a space and the word
        self._texts: dict[bytes, bytes] = {}  # such ids to what they show
        self._entries, self._chars, self._array_chars = memo_entries, memo_chars, array_chars

    def _symbol(self, piece: str) -> int:
        return int(self._symbol_of[ord(piece)]) if len(piece) == 1 else self._id.get(piece, -1)

    def _pairs(self, pieces: dict[str, float]) -> None:
        """A table of open addresses from two symbols to the rank and the id of the piece that they make."""
        found = [(self._symbol(p[:k]), self._symbol(p[k:]), self._rank[p], self._id[p]) for p in pieces for k in range(1, len(p))]
        a, b, rank, merged = (np.array(x, np.int64) for x in zip(*[f for f in found if f[0] >= 0 and f[1] >= 0], strict=True))
        keys = (a << 32) | b
        self._bits = max(10, int(len(keys) * 4).bit_length())
        self._keys, self._ranks, self._merged = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, _NEVER, np.int32), np.zeros(1 << self._bits, np.int32)
        left, at, self._probes = np.arange(len(keys)), self._place(keys), 0
        while len(left):
            free = self._keys[at[left]] == -1
            put = left[free]
            self._keys[at[put]] = keys[put]  # of several the last stays
            won = put[self._keys[at[put]] == keys[put]]
            self._ranks[at[won]], self._merged[at[won]] = rank[won], merged[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & ((1 << self._bits) - 1)
            self._probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where in the table each pair is; a place of rank ``_NEVER`` if nowhere."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._place(keys)
        open_ = np.flatnonzero(self._keys[at] != keys)
        for _ in range(self._probes):
            open_ = open_[self._keys[at[open_]] != -1]  # an empty place ends the search
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            open_ = open_[self._keys[at[open_]] != keys[open_]]
            if not len(open_):
                break
        return at

    def _merge_all(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of the words whose ``symbols`` stand one after the other; ``owner`` says whose each is, ascending."""

        agenda = np.full(len(symbols), _NEVER, np.int32)
        pairs = np.flatnonzero(owner[:-1] == owner[1:])
        agenda[pairs] = self._ranks[self._look_up(symbols[pairs], symbols[pairs + 1])]
        done = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(agenda, first)
            goes = best < _NEVER
            if not goes.all():
                stays = np.repeat(~goes, sizes)
                done.append((symbols[stays], owner[stays]))
                symbols, owner, agenda = symbols[~stays], owner[~stays], agenda[~stays]
                if not len(symbols):
                    break
                best, sizes = best[goes], sizes[goes]
            hits = np.flatnonzero(agenda == np.repeat(best, sizes))
            at = hits[np.concatenate(([True], owner[hits][1:] != owner[hits][:-1]))]
            symbols[at] = self._merged[self._look_up(symbols[at], symbols[at + 1])]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, agenda = symbols[keep], owner[keep], agenda[keep]
            at = at - np.arange(len(at))  # one place goes before each
            for around in (at, at - 1):
                around = around[around >= 0]
                pair = around[around + 1 < len(symbols)]
                pair = pair[owner[pair] == owner[pair + 1]]
                agenda[around] = np.where(owner[around] == owner[np.minimum(around + 1, len(symbols) - 1)], agenda[around], _NEVER)
                agenda[pair] = self._ranks[self._look_up(symbols[pair], symbols[pair + 1])]
                agenda[around[around + 1 >= len(symbols)]] = _NEVER
        if not done:
            return symbols, owner
        symbols, owner = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _merge_long(self, text: str) -> np.ndarray:
        """The symbols of one word after all merges."""
        symbols = list(text)
        rank, n = self._rank.get, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int]] = []  # (rank, place, length of the pair)

        def add(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := rank(symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (r, a, len(symbols[a]) + len(symbols[b])))

        for k in range(n - 1):
            add(k, k + 1)
        while agenda:
            _, a, length = heapq.heappop(agenda)
            b = right[a]
            if not symbols[a] or b >= n or len(symbols[a]) + len(symbols[b]) != length:
                continue  # one of the two has been merged since
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            add(left[a], a)
            add(a, right[a])
        return np.array([self._symbol(s) for s in symbols if s], np.int32)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of a space and each word."""
        short = [w for w in words if len(w) < self._array_chars]
        sizes = np.fromiter(map(len, short), np.int64, len(short)) + 1
        points = np.frombuffer("".join([" " + w for w in short]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, owner = self._merge_all(self._symbol_of[points], np.repeat(np.arange(len(short)), sizes))
        long = [w for w in words if len(w) >= self._array_chars]
        merged = [self._merge_long(SPACE + w.replace(" ", SPACE)) for w in long]
        if merged:
            owner = np.concatenate([owner, *(np.full(len(m), len(short) + k) for k, m in enumerate(merged))])
            symbols = np.concatenate([symbols, *merged])
        ids, counts = self._with_bytes(symbols)
        ends = np.cumsum(np.bincount(owner, counts, len(words)).astype(np.int64)) * 4
        packed = _slices(ids.astype("<u4").tobytes(), ends)
        if not long:
            return packed
        of = dict(zip([*short, *long], packed, strict=True))
        return [of[w] for w in words]

    def _with_bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, characters without a piece as their bytes, and how many each symbol has."""
        counts = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= self._beyond)
        points, which = np.unique(symbols[odd] - self._beyond, return_inverse=True)
        coded = [chr(c).encode("utf-8", "replace") for c in points.tolist()]
        table = np.zeros((len(coded) + 1, 4), np.int32)
        for k, c in enumerate(coded):
            table[k, : len(c)] = self._byte_ids[list(c)]
        sizes = np.array([len(c) for c in coded], np.int64)
        counts[odd] = sizes[which] if len(odd) else 1
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        ids[at] = np.where(symbols >= self._beyond, 0, symbols)
        for j in range(4):
            has = sizes[which] > j if len(odd) else np.zeros(0, bool)
            ids[at[odd[has]] + j] = table[which[has], j]
        return ids, counts

    def _decode_words(self, packed: list[bytes]) -> list[bytes]:
        """What each of the packed ids shows, spaces included."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        sizes = self._shown_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self._shown[np.arange(total) + np.repeat(self._shown_at[ids] - (ends - sizes), sizes)].tobytes()
        words = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        return _slices(data, np.concatenate(([0], ends))[words])

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, packed as little-endian 32-bit integers with begin and end, and what they decode to in UTF-8."""
        texts = [t.replace(SPACE, " ") for t in texts]
        split = [t.split(" ") if "  " not in t and t[:1] != " " else [w[1:] for w in self._spaced.findall(" " + t)] for t in texts]
        distinct = set().union(*split)
        if len(self._words) + len(distinct) > self._entries:  # those of this call stay
            self._words = {w: self._words[w] for w in distinct.intersection(self._words)}
            self._texts = {c: self._texts[c] for c in self._words.values()}
        words, shown = self._words, self._texts
        new = list(distinct.difference(words))
        if new:
            coded = self._encode_words(new)
            back = self._decode_words(coded)
            words.update(zip(new, coded, strict=True))
            shown.update(zip(coded, back, strict=True))
        out = []
        for text, parts in zip(texts, split, strict=True):
            if text:
                ids = list(map(words.__getitem__, parts))
                out.append((b"".join([self.begin, *ids, self.end]), b"".join(map(shown.__getitem__, ids))[1:]))
            else:
                out.append((self.begin + self.end, b""))
        if len(max(distinct, key=len, default="")) > self._chars:  # long words are known in this call only
            for w in [w for w in distinct if len(w) > self._chars]:
                shown.pop(words.pop(w), None)
        return out

    def check(self, text: str, ids: bytes, decoded: bytes) -> None:
        """An error unless the library encodes ``text`` as ``ids`` and decodes those as ``decoded``."""
        theirs = self.library.encode(text, add_bos=True, add_eos=True, num_threads=1)
        if unpacked(ids) != theirs or decoded.decode() != self.library.decode(theirs):
            raise ValueError(f"the library encodes or decodes a text of {len(text)} characters in another way: {text[:200]!r}")


def unpacked(ids: bytes) -> list[int]:
    """The ids in a value of column ``ids``."""
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def encoded(df: DataFrame, model_path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", memo_entries: int = 800_000, check_every: int = 100, block_bytes: int = 1 << 22) -> DataFrame:
    """One row per row of ``df``: id, ``ids`` (binary, little-endian unsigned 32-bit integers with begin and end), ``decoded``.

    ``model_path`` is the file's path, or a function that gives it on the executor. Texts go by in blocks of about
    ``block_bytes``, so that a task holds a few times that beside what it remembers, or the longest text.
    """
    schema = df.select(id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            path = model_path() if callable(model_path) else model_path
            key = (path, memo_entries)
            if key not in _encoders:  # kept from task to task
                _encoders[key] = Encoder(path, memo_entries)
            encoder = _encoders[key]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            lo = 0
            while lo < batch.num_rows:
                hi, held = lo, 0
                while hi < batch.num_rows and (hi == lo or held + sizes[hi] <= block_bytes):
                    held += sizes[hi]
                    hi += 1
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                pairs = encoder.encode_decode(texts)
                for k in range(-lo % check_every, hi - lo, check_every):
                    encoder.check(texts[k], *pairs[k])
                ids, back = pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, back], names=[id_col, "ids", "decoded"])
                lo = hi

    return df.select(id_col, df[text_col].cast("string").alias("text")).mapInArrow(run, f"{schema}, ids binary, decoded string")
