"""SimHash near-duplicates: exact Hamming linkage with a Gray-order hierarchical index.

Fingerprints. Texts are folded (A-Z only), cut at ASCII white space, and each run of four words, repeats
included, is hashed with XXH64 (seed 42); a fingerprint bit is 1 if it is set in over half of the hashes.

Index. Distinct fingerprints in order of Gray rank are cut into blocks of bounded size. In a block, each
node of the hierarchy covers consecutive fingerprints and factors out what they share: the bits that are
1 in all and the bits that are 0 in all. Two blocks are joined from the root down. The bits on which two
nodes are known to differ accumulate on the way; a pair of groups with more than ``radius`` is pruned
whole. A pair of groups whose undetermined and differing bits together are at most ``radius`` is accepted
whole, and a pair that one component already covers is skipped, so a group of near copies costs links in
proportion to its size, not to its square. No link is lost: what is pruned is further than ``radius``
apart, and what is skipped is linked by way of others.

Blocks. The block patterns of all fingerprints are a small table (one row for each block); block pairs
within ``radius`` are the tasks. A task holds two blocks at most and yields a spanning forest. Forests are
joined by ``connected_components``.

Cases: null or empty text, or text of white space, has fingerprint 0 and is linked like any other; fewer
than four words are one shingle; equal fingerprints are one vertex, so copies are never paired; null ids
take part and are never the smallest id unless alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.operators.components import connected_components

from .shared import maybe_broadcast, written

_FAN = 4


def fingerprint(text: str | None, words: int = 4, run: int = 1 << 16) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, last, run):  # so that a very long text takes its words and one run of shingles
        part = found[lo : lo + run + words - 1]
        hashes = [digest(join(four), 42) for four in zip(*(part[k:] for k in range(words)), strict=False)] if last > 1 else [digest(join(found), 42)]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = counts * 2 > last
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = df.select(F.col(id_col).alias("doc_id")).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"{schema}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray code: bit i is the parity of the bits from i upwards."""
    rank = fps.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(col: str):
    rank = F.col(col)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))  # signed order is then the unsigned order


class Forest:
    """Union-find over arrays; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.changed = True

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            ra, rb = p[a], p[b]
            differ = ra != rb
            if not differ.any():
                return
            self.changed = True
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            self.parent[np.maximum(ra, rb)] = np.minimum(ra, rb)


def hierarchy(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up: (bits that are 1 in all, bits that are 1 in any) of each node."""
    levels = [(fps, fps)]
    while len(levels[-1][0]) > _FAN:
        at = np.arange(0, len(levels[-1][0]), _FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_or.reduceat(levels[-1][1], at)))
    return levels


def link_blocks(left: np.ndarray, right: np.ndarray | None, radius: int, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of places in ``left`` followed by ``right``, of all links between the two blocks.

    Blocks are in order of Gray rank. Without ``right`` the links are those within ``left``.
    """
    own = right is None
    right = left if own else right
    forest = Forest(len(left) + (0 if own else len(right)))
    shift = 0 if own else len(left)
    a_levels, b_levels = hierarchy(left), hierarchy(right)
    top = max(len(a_levels), len(b_levels)) - 1
    labels: list = []

    def node(levels: list, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        deep = min(level, len(levels) - 1)
        return levels[deep][0][i], levels[deep][1][i], deep

    def uniform(first: int, n: int, depth: int) -> list[np.ndarray]:
        """For each level the component that covers a node, or -1."""
        out = [forest.roots()[first : first + n]]
        for _ in range(depth - 1):
            at = np.arange(0, len(out[-1]), _FAN)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def children(levels: list, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes one level down, padded to the fan-out, and which of them exist."""
        if level > len(levels) - 1:
            kids = np.repeat(i[:, None], 1, axis=1)
            return kids, np.ones_like(kids, bool)
        kids = i[:, None] * _FAN + np.arange(_FAN)
        return kids, kids < len(levels[level - 1][0])

    def refresh() -> None:
        if forest.changed:
            labels[:] = [uniform(0, len(left), len(a_levels)), uniform(shift, len(right), len(b_levels))]
            forest.changed = False

    a0, b0 = np.meshgrid(np.arange(len(a_levels[min(top, len(a_levels) - 1)][0])), np.arange(len(b_levels[min(top, len(b_levels) - 1)][0])), indexing="ij")
    stack = [(top, a0.ravel(), b0.ravel())]
    refresh()
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            stack += [(level, a[k : k + chunk], b[k : k + chunk]) for k in range(0, len(a), chunk)]
            continue
        if own:
            a, b = a[keep := a <= b], b[keep]
        one_a, any_a, deep_a = node(a_levels, level, a)
        one_b, any_b, deep_b = node(b_levels, level, b)
        differ = np.bitwise_count((one_a & ~any_b) | (one_b & ~any_a))
        near = differ <= radius
        a, b, one_a, any_a, one_b, any_b = a[near], b[near], one_a[near], any_a[near], one_b[near], any_b[near]
        if not len(a):
            continue
        refresh()
        la, lb = labels[0][deep_a][a], labels[1][deep_b][b]
        apart = (la != lb) | (la < 0)
        a, b, one_a, any_a, one_b, any_b = a[apart], b[apart], one_a[apart], any_a[apart], one_b[apart], any_b[apart]
        if level == 0:
            forest.union(a, b + shift)
            continue
        whole = np.bitwise_count(~((one_a & one_b) | (~any_a & ~any_b))) <= radius
        if whole.any():
            size_a, size_b = _FAN**deep_a, _FAN**deep_b
            for x, y in zip(a[whole], b[whole], strict=True):
                xs = np.arange(x * size_a, min((x + 1) * size_a, len(left)))
                ys = np.arange(y * size_b, min((y + 1) * size_b, len(right))) + shift
                members = np.concatenate((xs, ys))
                forest.union(members[1:], np.full(len(members) - 1, members[0]))
            a, b = a[~whole], b[~whole]
        kids_a, real_a = children(a_levels, level, a)
        kids_b, real_b = children(b_levels, level, b)
        pairs = real_a[:, :, None] & real_b[:, None, :]
        next_a = np.broadcast_to(kids_a[:, :, None], pairs.shape)[pairs]
        next_b = np.broadcast_to(kids_b[:, None, :], pairs.shape)[pairs]
        stack.append((level - 1, next_a, next_b))
    p = forest.roots()
    linked = np.flatnonzero(p != np.arange(len(p)))
    return linked, p[linked]


def hamming_components(distinct: DataFrame, radius: int = 4, block_rows: int = 1 << 20, least_blocks: int = 6) -> DataFrame:
    """(vertex, component) of fingerprints ``fp`` (distinct, in a written table) that have a link within ``radius``."""
    rows = distinct.count()
    blocks = max(-(-rows // block_rows), min(least_blocks, -(-rows // 1000)), 1)
    ranked = distinct.select("fp", gray_rank_column("fp").alias("rank"))
    ranked = written(ranked.repartitionByRange(blocks, "rank").withColumn("part", F.spark_partition_id()), "gray")
    parts = (ranked.agg(F.max("part")).first()[0] or 0) + 1
    # neighbouring range partitions make a block, however many partitions the session made of them
    ranked = ranked.withColumn("block", F.expr(f"cast(part * {min(blocks, parts)} div {parts} as int)")).drop("part")
    # Upper nodes: what all fingerprints of a block share. One row a block.
    uppers = ranked.groupBy("block").agg(F.bit_and("fp").alias("one"), F.bit_or("fp").alias("any"))
    i, j = uppers.select(*[F.col(c).alias(f"{c}_i") for c in uppers.columns]), uppers.select(*[F.col(c).alias(f"{c}_j") for c in uppers.columns])
    known = F.bit_count(F.expr("(one_i & ~any_j) | (one_j & ~any_i)"))
    tasks = [(r.block_i, r.block_j) for r in i.join(F.broadcast(j), (F.col("block_i") <= F.col("block_j")) & (known <= radius)).select("block_i", "block_j").collect()]
    spark = distinct.sparkSession
    sides = [(k, b, a, c) for k, (a, c) in enumerate(tasks) for b in sorted({a, c})]
    routes = spark.createDataFrame(sides or [], "task int, block int, i int, j int")
    routed = ranked.join(F.broadcast(routes), "block").select("task", "block", "i", "j", "fp")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        side = []
        for b in sorted({i, j}):
            fps = rows["fp"].to_numpy()[rows["block"].to_numpy() == b].view(np.uint64)
            side.append(fps[np.argsort(gray_rank(fps), kind="stable")])
        a, b = link_blocks(side[0], side[1] if len(side) > 1 else None, radius)
        fps = np.concatenate(side).view(np.int64)
        # each tree hangs on the least of its fingerprints, so the components have few rounds left
        forest = pd.DataFrame({"u": np.concatenate((fps[a], fps[b])), "root": np.concatenate((b, b))}).drop_duplicates()
        forest["v"] = forest.groupby("root")["u"].transform("min")
        return forest.loc[forest["u"] != forest["v"], ["u", "v"]]

    forests = routed.repartition(max(1, len(tasks)), "task").groupBy("task").applyInPandas(run, "u long, v long")
    return connected_components(written(forests, "forests"))


def _classes(marked: DataFrame, radius: int, **search: int) -> DataFrame:
    """(fp, component, least) of the distinct fingerprints of a written table with doc_id and fp."""
    vertices = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    found = hamming_components(vertices.select("fp"), radius, **search)
    return vertices.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", **search: int) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable)."""
    marked = written(fingerprints(df, id_col, text_col), "fingerprints")
    classes = _classes(marked, radius, **search)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    per_fp = written(classes.join(least, "component").select("fp", "component_id"), "per-fingerprint")
    return marked.join(maybe_broadcast(per_fp, 200_000), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", **search: int) -> DataFrame:
    """The rows of ``df`` that have the least id of their component, one for each component, with all their columns.

    Rows with equal ids are told apart by their text; rows equal in both stay or go together.
    """
    row = F.xxhash64(F.col(text_col).cast("string"))
    keyed = df.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row.alias("row")).alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(fingerprints(keyed, "doc_id", "text"), "fingerprints")
    classes = written(_classes(marked, radius, **search), "classes")
    stay = classes.groupBy("component").agg(F.min("least").alias("least")).select("least")
    go = written(marked.join(stay, marked["doc_id"] == F.col("least"), "left_anti").select(F.col("doc_id.id").alias("__id"), F.col("doc_id.row").alias("__row")).distinct(), "near-copies")
    go = maybe_broadcast(go)
    return df.join(go, df[id_col].eqNullSafe(go["__id"]) & (row == go["__row"]), "left_anti")
