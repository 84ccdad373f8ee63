"""Best-fit packing with conflicts.

Texts are cut into pieces of at most ``capacity`` (characters and one separator); a bin holds pieces of
that size together, never two of one source, nor two of one duplicate cluster. Bins are kept in order of
what is left in them and carry a bitmap of their sources and one of their clusters. A piece goes to the
successor of its size, the fullest bin that still has room; while that bin conflicts the search goes on
to the next, so the piece ends in the tightest compatible bin, or opens one. Pieces come largest first.

A bit that is clear proves that there is no conflict. With more than 64 sources or clusters a bit stands
for several, and a set bit is settled by the bin's own lists, so aliases never cost a place.

Pieces are dealt to blocks of about ``block_rows`` by a hash of a number that each row
gets, which no source, cluster, size or repeated row can skew, and every block is packed by itself; only fixed-size rows shuffle, not text.

Cases: null and empty texts take the separator's size; a null source or cluster conflicts with nothing;
repeated rows are packed each, in different bins if they share a cluster; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of, written


class Bins:
    """Open bins in order of residual, with their bitmaps."""

    def __init__(self, capacity: int, n: int):
        self.capacity = capacity
        self.room = np.zeros(n, np.int64)  # residuals in order, of the first ``open`` bins
        self.bin = np.zeros(n, np.int64)
        self.open = 0
        self.count = 0
        self.sources, self.clusters = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.held: list[tuple[set, set]] = []

    def _clashes(self, b: int, source: int, cluster: int) -> bool:
        sources, clusters = self.held[b]
        return source in sources or cluster in clusters

    def find(self, size: int, source: int, cluster: int, aliases: bool) -> int:
        """The place, in the order, of the tightest compatible bin, or -1."""
        at, step = int(np.searchsorted(self.room[: self.open], size)), 64
        s = np.uint64(0 if source < 0 else 1 << (source & 63))
        c = np.uint64(0 if cluster < 0 else 1 << (cluster & 63))
        while at < self.open:
            part = self.bin[at : min(at + step, self.open)]
            clear = ((self.sources[part] & s) | (self.clusters[part] & c)) == 0
            first = int(clear.argmax()) if clear.any() else len(part)
            if aliases:
                for k in range(first):
                    if not self._clashes(int(part[k]), source, cluster):
                        return at + k
            if first < len(part):
                return at + first
            at, step = at + len(part), step * 2
        return -1

    def put(self, place: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the bin at ``place``, or into a new one; return the bin and the place in it."""
        if place < 0:
            b, room = self.count, self.capacity
            self.count += 1
            self.held.append((set(), set()))
        else:
            b, room = int(self.bin[place]), int(self.room[place])
            self.room[place : self.open - 1] = self.room[place + 1 : self.open]
            self.bin[place : self.open - 1] = self.bin[place + 1 : self.open]
            self.open -= 1
        if source >= 0:
            self.sources[b] |= np.uint64(1 << (source & 63))
            self.held[b][0].add(source)
        if cluster >= 0:
            self.clusters[b] |= np.uint64(1 << (cluster & 63))
            self.held[b][1].add(cluster)
        left = room - size
        if left > 0:
            to = int(np.searchsorted(self.room[: self.open], left, "right"))
            self.room[to + 1 : self.open + 1] = self.room[to : self.open]
            self.bin[to + 1 : self.open + 1] = self.bin[to : self.open]
            self.room[to], self.bin[to] = left, b
            self.open += 1
        return b, self.capacity - room


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces that come in the order given. Sources and clusters are small numbers, -1 for none."""
    bins = Bins(capacity, len(sizes))
    aliases = max(sources.max(initial=0), clusters.max(initial=0)) >= 64
    out = np.zeros((2, len(sizes)), np.int64)
    for k, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        out[:, k] = bins.put(bins.find(size, source, cluster, aliases), size, source, cluster)
    return out[0], out[1]


def _codes(values: pd.Series, shared_only: bool) -> np.ndarray:
    codes, _ = pd.factorize(values)
    if shared_only:  # a value that occurs once can't clash
        codes = np.where((codes >= 0) & (np.bincount(codes[codes >= 0], minlength=max(1, codes.max(initial=0) + 1))[codes] > 1), codes, -1)
        codes = np.where(codes >= 0, pd.factorize(pd.Series(codes).where(codes >= 0))[0], -1)
    return codes


def best_fit(df: DataFrame, capacity: int = 8192, block_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, size (with the separator), bin, offset.

    ``cluster`` gives the duplicate cluster of a row; without it equal texts are a cluster.
    """
    text = text_of(text_col)
    cluster = F.xxhash64(text) if cluster is None else cluster
    rows = df.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("chars"), F.xxhash64(F.col(source_col)).alias("hash"), F.col(source_col).isNull().alias("no_source"), cluster.cast("long").alias("cluster"))
    # rows that are equal in all columns are dealt by themselves, too
    rows = written(rows.select("doc_id", "chars", F.when(~F.col("no_source"), F.col("hash")).alias("source"), "cluster", F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "sizes")
    most = capacity - 1
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(chars - 1) div {most}")))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "deal", "piece", (F.col("piece") * most).alias("start"), (F.least(F.lit(most), F.col("chars") - F.col("piece") * most) + 1).cast("long").alias("size"))
    n_pieces = rows.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.expr(f"(chars - 1) div {most} + 1"))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_pieces // block_rows))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("deal", "piece"), F.lit(n_blocks)).cast("long")).drop("deal")
    id_type = df.select(id_col).schema.fields[0].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = pack(part["size"].to_numpy(), _codes(part["source"], False), _codes(part["cluster"], True), capacity)
        return pd.DataFrame({c: part[c].tolist() for c in ("doc_id", "piece", "start", "size")}).assign(bin=part["block"].to_numpy() * (1 << 32) + bins, offset=offsets)

    # as text, hashes keep all their bits where a block has nulls
    pieces = pieces.withColumn("source", F.col("source").cast("string")).withColumn("cluster", F.col("cluster").cast("string"))
    return pieces.groupBy("block").applyInPandas(run, f"doc_id {id_type}, piece long, start long, size long, bin long, offset long")
