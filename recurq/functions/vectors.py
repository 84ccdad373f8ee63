"""Vectors: hash embeddings, products, norms, means, and similarity joins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+")


#: Bytes of vectors that a task hands on at once; a batch of texts has more of them than a worker should hold.
OUT_BYTES = 4 << 20


@lru_cache(maxsize=1 << 16)
def _place(token: str) -> tuple[int, float]:
    """The number of a word, before it is taken modulo the dimension, and its sign."""
    digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big"), 1.0 if digest[4] % 2 == 0 else -1.0


def hash_vector(folded: str, dim: int = 96) -> np.ndarray:
    """The signed hashing of a text's words into ``dim`` places, of length 1; a text without words is zero."""
    out = np.zeros(dim)
    for token in _TOKEN.findall(folded):
        number, sign = _place(token) if len(token) <= 64 else _place.__wrapped__(token)
        out[number % dim] += sign
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def hash_embedding(dim: int = 96):
    """A vectorised function from folded text to its hash vector; Spark has no BLAKE2 of its own. Vectors leave in slices of ``OUT_BYTES``."""
    rows = max(1, OUT_BYTES // (8 * dim))

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("")
            for k in range(0, len(texts), rows):
                yield pd.Series([hash_vector(t, dim) for t in texts.iloc[k : k + rows]], dtype=object)

    return embed


def embedding_backend(encode, batch: int = 64):
    """A vectorised function from text to vector by ``encode``, a function that loads a model on its first call
    on an executor and takes a list of texts."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            texts = many.fillna("").tolist()
            for k in range(0, len(texts), batch):
                x = np.asarray(encode(texts[k : k + batch]), float)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                yield pd.Series(list(np.divide(x, norm, out=x, where=norm > 0)), dtype=object)

    return embed


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector of each group, by place, so that partial sums combine before the shuffle."""
    places = df.select(*keys, F.posexplode(as_double(vector)).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return places.groupBy(*keys).agg(ordered.alias("mean"))


#: A large group has ``BLOCKS`` blocks, so its rows are copied that often whatever its size, until a block has ``MOST_BLOCK_ROWS``.
BLOCKS, MOST_BLOCK_ROWS = 8, 32_768


def block_count(rows: Column, block_rows: int) -> Column:
    """How many blocks a group is dealt to: blocks have at least about ``block_rows`` rows."""
    return F.greatest(F.lit(1), F.least(F.ceil(rows / block_rows), F.lit(BLOCKS)), F.ceil(rows / max(block_rows, MOST_BLOCK_ROWS))).cast("int")


def tiles(x: np.ndarray, y: np.ndarray, rows: int = 1024, columns: int = 4096) -> Iterator[tuple[int, int, np.ndarray]]:
    """The products of all rows of ``x`` with all of ``y`` in tiles: first row, first column, products."""
    for a in range(0, len(x), rows):
        for b in range(0, len(y), columns):
            yield a, b, x[a : a + rows] @ y[b : b + columns].T


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, within: str | None = None, block_rows: int = 2048) -> DataFrame:
    """(a, b, sim) for all pairs a < b, in one group of ``within``, whose product is at least ``least``.

    Rows are dealt to blocks and pairs of blocks are multiplied as matrices, so no pair is a row before it
    qualifies, and a task holds two blocks and the pairs of one tile whatever the size of a group.
    """
    rows = df.select(F.col(key).alias("k"), as_double(vector).alias("v"), (F.col(within) if within else F.lit(0)).alias("g"))
    blocks = rows.groupBy("g").agg(block_count(F.count(F.lit(1)), block_rows).alias("n"))
    dealt = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    sides = dealt.select("g", "k", "v", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    sides = sides.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "v")
    kind = df.schema[key].dataType.simpleString()

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches), ignore_index=True)
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        left, right = part[part["own"] == i], part[part["own"] == j]
        if left.empty or right.empty:
            return
        ours, theirs = np.array(left["k"].tolist()), np.array(right["k"].tolist())
        for lo, hi, sims in tiles(np.stack(left["v"].to_list()), np.stack(right["v"].to_list())):
            x, y = np.nonzero(sims >= least)
            a, b = ours[x + lo], theirs[y + hi]
            keep = a < b if i == j else a != b
            yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sims[x, y][keep]})

    return sides.groupBy("g", "i", "j").applyInPandas(product, f"a {kind}, b {kind}, sim double")


def nearest(queries: DataFrame, known: DataFrame, key: str, vector: str, within: str | None = None, bucket_rows: int = 20_000) -> DataFrame:
    """(key, best) the largest product of each query with any known vector of its group; null where there is none.

    Known vectors are dealt by a hash to buckets of about ``bucket_rows``; each (group, bucket) is a matrix product, and the maxima combine.
    """
    buckets = max(1, -(-known.count() // bucket_rows))
    g = F.col(within) if within else F.lit(0)
    q = queries.select(F.col(key).alias("k"), as_double(vector).alias("v"), g.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    k = known.select(as_double(vector).alias("v"), g.alias("g")).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    kind = queries.schema[key].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"k": pd.Series([], dtype=object), "best": pd.Series([], dtype=float)})
        sims = np.stack(left["v"].to_list()) @ np.stack(right["v"].to_list()).T
        return pd.DataFrame({"k": pd.Series(left["k"].tolist(), dtype=object), "best": sims.max(axis=1)})

    found = q.groupBy("g", "bucket").cogroup(k.groupBy("g", "bucket")).applyInPandas(best, f"k {kind}, best double")
    top = found.groupBy("k").agg(F.max("best").alias("best"))
    return queries.select(key).join(top.withColumnRenamed("k", key), key, "left")
