"""Collocations: phrases that are much more frequent than chance joins of their parts, by language.

Documents are counted in shards of bounded size. A shard's phrases are a trie of limited depth below each
language: a node is a phrase, its parent the phrase without the last word. Level by level a trie is two sorted
arrays, the node's parent and word in one number, and its count. It is serialised in sorted order and cut
into prefix ranges; for each range the sorted runs of all shards are merged and equal phrases summed, one range at
a time. Bounds of ranges come from quantiles of a sample of words; they bear on the balance only.

A phrase cannot be more frequent than its parts, so there are three passes: words; pairs of frequent words;
phrases of three and four words all of whose pairs are frequent. What is frequent is told to the next pass by a
Bloom filter, sized by the number of its keys: a false positive is counted in vain, never lost. Its size is
bounded by ``filter_bytes``; beyond, it lets more through, and the result is the same.

Of the merged trie, a walk from the root gives the counts of a phrase's left parts, and suffix links, from a
phrase to the one without its first word, give those of its right parts; both are joins of one level with the level
above. The best rows of a language are chosen within buckets first, so that no language is one task.

Cases: a null or empty text has no word, a null language is ``und``; repeated rows count each; a very long text
is counted whole; equal scores are ordered by count, then by the phrase's bytes; an empty table, or one
without a frequent phrase, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_path, maybe_broadcast, text_of, written_at

#: One byte for all that ends a piece, a space for the tab, small letters for A to Z.
_BREAK = b"."
_FOLD = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), _BREAK * 9 + b" " + bytes(range(97, 123)))
_TRIE = "lang string, part int, n long, phrases binary, counts binary"
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with ``_BREAK`` between its pieces. A word may have any byte but a space, tab or break."""
    return text.translate(_FOLD).replace(_BREAK, b" . ").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C1
    return h ^ (h >> np.uint64(32))


class Filter:
    """A Bloom filter of phrases, three bits each, in the bytes ``bits``."""

    def __init__(self, bits: np.ndarray):
        self.bits, self._mask = bits, np.uint64(len(bits) * 8 - 1)

    @classmethod
    def empty(cls, keys: int, most_bytes: int) -> Filter:
        size = 1 << max(10, int(2 * keys).bit_length())
        while size > most_bytes:
            size //= 2
        return cls(np.zeros(size, np.uint8))

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        second = _mixed(h ^ _C2) | np.uint64(1)
        return [(h + np.uint64(k) * second) & self._mask for k in range(3)]

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._places(h):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(first * _C2 + second)


class Shard:
    """Words of documents of one language, as numbers, and the tries of their phrases."""

    def __init__(self, lang: str):
        self.lang = lang
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        words = tokens(_BREAK.join(texts) + _BREAK)
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def sorted(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The vocabulary in order, the text as its places in it, and where words are."""
        words = sorted(self.vocabulary)
        rank = np.zeros(len(words), np.int32)
        rank[np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))] = np.arange(len(words), dtype=np.int32)
        ids = rank[np.concatenate(self.parts)] if self.parts else np.zeros(0, np.int32)
        breaks = self.vocabulary.get(_BREAK)
        return words, ids, np.ones(len(ids), bool) if breaks is None else ids != rank[breaks]

    def tries(self, level: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """(length, nodes, counts, vocabulary) of phrases: of words at level 1, pairs at 2, three and four words at 3.

        Nodes are rows of word numbers, in order. At level 1 the root comes first, with length 0.
        """
        words, ids, is_word = self.sorted()
        if level == 1:
            found = np.bincount(ids[is_word], minlength=len(words))
            at = np.flatnonzero(found)
            yield 0, np.zeros((1, 0), np.int64), np.array([found.sum()]), words
            yield 1, at[:, None], found[at], words
            return
        hashes = word_hashes(self.lang, words)
        often = filters[0].has(hashes)[ids] & is_word
        pairs = np.flatnonzero(often[:-1] & often[1:])
        if level == 2:
            yield 2, *_counted(ids[pairs].astype(np.int64) << 32 | ids[pairs + 1], 2), words
            return
        good = np.zeros(len(ids) + 2, bool)
        good[pairs] = filters[1].has(pair_hashes(hashes[ids[pairs]], hashes[ids[pairs + 1]]))
        three = np.flatnonzero(good[:-1] & good[1:])
        nodes, parent = np.unique(ids[three].astype(np.int64) << 32 | ids[three + 1], return_inverse=True)
        keys = parent.astype(np.int64) << 32 | ids[three + 2]
        above, counts = _counted(keys, 2)
        of = np.column_stack((nodes[above[:, 0]] >> 32, nodes[above[:, 0]] & 0xFFFFFFFF, above[:, 1])) if len(above) else np.zeros((0, 3), np.int64)
        yield 3, of, counts, words
        nodes, parent = np.unique(keys, return_inverse=True)
        four = np.flatnonzero(good[three + 2])
        above, counts = _counted(parent[four].astype(np.int64) << 32 | ids[three[four] + 3], 2)
        yield 4, np.column_stack((of[above[:, 0]], above[:, 1])) if len(above) else np.zeros((0, 4), np.int64), counts, words

    def serialised(self, level: int, filters: list[Filter], bounds: list[tuple[str, bytes, bytes]], rows: int = 200_000) -> Iterator[dict]:
        """The tries in order, cut at ``bounds`` (lang, first word, second word), as rows of ``_TRIE``."""
        for length, nodes, counts, words in self.tries(level, filters):
            if not len(nodes):
                continue
            table = pa.array(words, pa.binary())
            here = [k for k, b in enumerate(bounds) if b[0] == self.lang]
            least = here[0] if here else bisect_left(bounds, (self.lang, b"", b""))
            cuts = [0, *(self._place(nodes, words, *bounds[k][1:]) for k in here), len(nodes)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), least):
                for lo in range(a, b, rows):
                    hi = min(b, lo + rows)
                    yield {"lang": self.lang, "part": part, "n": hi - lo, "phrases": _packed(_joined(table, nodes[lo:hi])), "counts": counts[lo:hi].astype(np.int64).tobytes()}

    @staticmethod
    def _place(nodes: np.ndarray, words: list[bytes], first: bytes, second: bytes) -> int:
        """How many nodes come before the phrase of two words."""
        if not nodes.shape[1]:
            return len(nodes)
        a = bisect_left(words, first)
        lo = int(np.searchsorted(nodes[:, 0], a))
        if nodes.shape[1] == 1 or a == len(words) or words[a] != first:
            return lo
        hi = int(np.searchsorted(nodes[:, 0], a + 1))
        return lo + int(np.searchsorted(nodes[lo:hi, 1], bisect_left(words, second)))


def _counted(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order as rows of two numbers, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    nodes = keys[first]
    return np.column_stack((nodes >> 32, nodes & 0xFFFFFFFF)), np.diff(np.append(first, len(keys)))


def _joined(words: pa.Array, nodes: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    columns = [words.take(pa.array(nodes[:, k])) for k in range(nodes.shape[1])]
    return pc.binary_join_element_wise(*columns, b" ") if columns else pa.array([b""] * len(nodes), pa.binary())


def _packed(phrases: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([phrases], names=["p"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all().column(0).combine_chunks()


def merged(runs: list[tuple[pa.Array, np.ndarray]], least: int) -> tuple[pa.Array, np.ndarray]:
    """Phrases of all sorted runs in order with their sums, those of ``least`` and the root's."""
    import pyarrow.compute as pc

    phrases, counts = pa.concat_arrays([p for p, _ in runs]), np.concatenate([c for _, c in runs])
    order = pc.sort_indices(phrases)
    phrases, counts = phrases.take(order), counts[order.to_numpy()]
    first = np.flatnonzero(np.concatenate(([True], pc.not_equal(phrases[1:], phrases[:-1]).to_numpy(zero_copy_only=False))))
    sums = np.add.reduceat(counts, first)
    phrases = phrases.take(pa.array(first))
    keep = (sums >= least) | (pc.binary_length(phrases).to_numpy() == 0)
    return phrases.filter(pa.array(keep)), sums[keep]


def _level(docs: DataFrame, level: int, filters: list[Filter], bounds: list[tuple[str, bytes, bytes]], least: int, shard_words: int, name: str) -> tuple[DataFrame, str]:
    """(lang, phrase, f) of the phrases of a level that are frequent in all documents, written, and their path."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(([f.bits for f in filters], bounds))
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bounds = shared.value
        filters, shards = [Filter(b) for b in bits], {}

        def flush() -> Iterator[pa.RecordBatch]:
            for shard in shards.values():
                for row in shard.serialised(level, filters, bounds):
                    yield pa.RecordBatch.from_pylist([row], schema)
            shards.clear()

        for batch in batches:
            lo = 0
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum([len(t.as_buffer()) for t in texts]) if len(langs) else []
            while lo < len(langs):  # by about 4 MB of text
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 22), "right")))
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[lo:hi], texts[lo:hi], strict=True):
                    by.setdefault(lang, []).append(text.as_buffer().to_pybytes())
                for lang, of in by.items():
                    shards.setdefault(lang, Shard(lang)).add(of)
                if sum(s.size for s in shards.values()) >= shard_words:
                    yield from flush()
                lo = hi
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if runs:
                phrases, sums = merged(runs, least)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(sums), pa.string()), phrases.cast(pa.string()), pa.array(sums, pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, part, phrases, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
                now = (lang.as_py(), part.as_py())
                if now != key:
                    yield from out()
                    key, runs = now, []
                runs.append((_unpacked(phrases.as_py()), np.frombuffer(counts.as_py(), np.int64)))
        yield from out()

    tries, tries_path = written_at(docs.mapInArrow(count, _TRIE), f"tries-{name}")
    dealt = tries.drop("n").repartition("lang", "part").sortWithinPartitions("lang", "part")
    table, path = written_at(dealt.mapInArrow(merge, "lang string, phrase string, f long"), f"phrases-{name}")
    drop_path(spark, tries_path)
    shared.destroy()
    return table, path


def _filter_of(table: DataFrame, words: int, most_bytes: int) -> Filter:
    """A filter of the phrases of ``words`` words in a written table; the bits of tasks are combined by place."""
    rows = table.filter("phrase <> ''")
    keys = rows.count()
    size = len(Filter.empty(keys, most_bytes).bits)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(size, np.uint8))
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            phrases = [p.encode() for p in batch.column(1).to_pylist()]
            for lang in set(langs.tolist()):
                of = [phrases[k].split(b" ") for k in np.flatnonzero(langs == lang)]
                hashes = [word_hashes(lang, [p[k] for p in of]) for k in range(words)]
                own.add(hashes[0] if words == 1 else pair_hashes(*hashes))
        own_words = own.bits.view(np.int64)
        at = np.flatnonzero(own_words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own_words[at])], names=["at", "bits"])

    found = rows.select("lang", "phrase").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 8, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return Filter(out.view(np.uint8))


def _bounds(docs: DataFrame, part_bytes: int, sample_texts: int) -> list[tuple[str, bytes, bytes]]:
    """Where to cut the tries, so that a range has the phrases of about ``part_bytes`` of text, by a sample of texts."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(total // part_bytes)
    if not parts:
        return []
    sample = docs.select("lang", F.substr("text", F.lit(1), F.lit(4000)).alias("text"), F.xxhash64("text", F.monotonically_increasing_id()).alias("k")).orderBy("k", "lang").limit(sample_texts).toArrow()
    pairs = []
    for lang, text in zip(sample["lang"].to_pylist(), sample["text"].to_pylist(), strict=True):
        words = tokens(text.encode())
        pairs += [(lang, a, b) for a, b in zip(words, words[1:], strict=False) if a != _BREAK and b != _BREAK]
    pairs.sort()
    return sorted({pairs[len(pairs) * k // (parts + 1)] for k in range(1, parts + 1)}) if pairs else []


def collocations(
    df: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", within_percent: int = 80,
    shard_words: int = 3_000_000, part_bytes: int = 8 << 20, sample_texts: int = 4000, filter_bytes: int = 1 << 26, buckets: int = 64,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words of each language.

    ``a`` is how often the phrase stands within a piece of text, ``l`` and ``r`` those counts of its parts at the cut with the
    lowest score, floor(2000000 a / (l + r)), ``n`` the language's words. Phrases are frequent from ``least`` on; those
    within a longer frequent one that has ``within_percent`` of their count are left out. The sample sets bounds only.
    """
    spark: SparkSession = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    bounds = _bounds(docs, part_bytes, sample_texts)
    paths, filters, levels = [], [], {}
    for level in (1, 2, 3):
        table, path = _level(docs, level, filters, bounds, least, shard_words, str(level))
        paths.append(path)
        levels[level] = table
        if level < 3:
            filters.append(_filter_of(table, level, filter_bytes))
    length = F.size(F.split("phrase", " ", -1))
    levels[3], levels[4] = (levels[3].filter(length == k) for k in (3, 4))
    totals = levels[1].filter("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    levels[1] = levels[1].filter("phrase <> ''")
    shorter = levels[1].select("lang", "phrase", "f", F.array("f").alias("lefts"), F.array("f").alias("rights"))
    scored = []
    for k in (2, 3, 4):
        # down from the parent: the counts on its walk, then one's own; along the suffix link: one's own, then its rights
        walk = levels[k].withColumn("parent", F.expr("substring_index(phrase, ' ', %d)" % (k - 1))).withColumn("suffix", F.expr("substr(phrase, 2 + length(substring_index(phrase, ' ', 1)))"))
        above, _path = written_at(shorter, f"level-{k}")
        paths.append(_path)
        walk = walk.join(maybe_broadcast(above.select("lang", F.col("phrase").alias("parent"), F.col("lefts").alias("before")), 200_000), ["lang", "parent"])
        walk = walk.join(maybe_broadcast(above.select("lang", F.col("phrase").alias("suffix"), F.col("rights").alias("behind")), 200_000), ["lang", "suffix"])
        here, _path = written_at(walk, f"walk-{k}")
        paths.append(_path)
        scored.append(here.select("lang", "phrase", F.col("f").alias("a"), "before", "behind"))
        shorter = here.select("lang", "phrase", "f", F.concat("before", F.array("f")).alias("lefts"), F.concat(F.array("f"), "behind").alias("rights"))
        if k > 2:
            longer = here.select("lang", F.explode(F.array("parent", "suffix")).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            scored[-2] = scored[-2].join(longer, ["lang", "phrase"], "left")
    scored[-1] = scored[-1].withColumn("longer", F.lit(None).cast("long"))
    rows = scored[0].unionByName(scored[1]).unionByName(scored[2])
    rows = rows.filter(f"longer IS NULL OR CAST(longer AS DECIMAL(30, 0)) * 100 < CAST(a AS DECIMAL(30, 0)) * {int(within_percent)}")
    cuts = F.zip_with("before", "behind", lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    rows = rows.withColumn("cuts", F.transform(cuts, lambda c, k: F.struct(F.call_function("div", F.lit(2000000).cast("decimal(20,0)") * F.col("a").cast("decimal(18,0)"), c["l"].cast("decimal(20,0)") + c["r"].cast("decimal(20,0)")).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    rows = rows.withColumn("best", F.array_min("cuts")).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out, _ = written_at(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for path in paths:
        drop_path(spark, path)
    return out


ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ws FROM w, range(1, 5) r(k)),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
parts AS (SELECT lang, k, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k >= 2)),
cuts AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS longer FROM (
  SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM f WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
