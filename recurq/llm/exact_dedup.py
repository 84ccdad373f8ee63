"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

The text is read once, into a table of digests (id, SHA-256, and a 64-bit hash of it). Pass one builds a
blocked Bloom filter of the hashes that occur at least twice: a hash selects one 64-bit word and three
bits in it; (word, bits) pairs that two or more rows set are kept and their bits OR-ed into the word.
Pass two tests every row against the filter. A repeated hash always hits; rows that miss are unique and
pass straight through without a shuffle. Only the rows that hit shuffle, on their SHA-256, and are
resolved exactly, so a false hit costs time and never a result. Groups of ``HOT_ROWS`` or more are few and are
joined by broadcast, so that a hot text is not one task.

The filter has ``2**filter_bits / 64`` words at most and is broadcast only when it has at most
``BROADCAST_ROWS`` non-empty words; beyond that the test is a shuffle join of digests.

At scale the pairs of pass one are the sparse form of per-task filters: 12 bytes a distinct digest, combined
on the map side, where dense filters would move their whole size for every task. A hot text collapses to
one pair in each map task.

Cases: null counts as empty; ids may be null (lowest) or repeated; of rows with equal text the largest id
stays, and of rows that also share that id exactly one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import maybe_broadcast, text_of, written

FILTER_BITS = 31
HOT_ROWS = 1000


def word_of(h: Column, filter_bits: int = FILTER_BITS) -> Column:
    """The filter word that a 64-bit hash selects: its upper bits."""
    return F.shiftrightunsigned(h, 64 - (filter_bits - 6)).cast("int")


def bits_of(h: Column) -> Column:
    """Three bits of a word, selected by the lower 18 bits of a hash."""
    return _bit(h, 0).bitwiseOR(_bit(h, 6)).bitwiseOR(_bit(h, 12))


def _bit(h: Column, at: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))


def repeated_filter(hashes: DataFrame, col: str = "h", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pass one: (word, bits) of all hashes that occur at least twice, and of a few that do not."""
    return (
        hashes.select(word_of(F.col(col), filter_bits).alias("__word"), bits_of(F.col(col)).alias("bits"))
        .groupBy("__word", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy("__word")
        .agg(F.bit_or("bits").alias("__filter_word"))
    )


def with_hits(df: DataFrame, filter_words: DataFrame, col: str = "h", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pass two: ``__possibly_repeated`` for each row."""
    tested = df.withColumn("__word", word_of(F.col(col), filter_bits)).join(filter_words, "__word", "left")
    bits = bits_of(F.col(col))
    return tested.withColumn("__possibly_repeated", F.coalesce(F.col("__filter_word").bitwiseAND(bits) == bits, F.lit(False))).drop("__word", "__filter_word")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256 as 32 bytes, a number of the row, h) of every row, written to the shared folder."""
    sha = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    return written(df.select(F.col(id_col).alias("doc_id"), sha.alias("sha"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("sha")), "digests")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    table = digests(df, id_col, text_col)
    filter_words = maybe_broadcast(written(repeated_filter(table, "h", filter_bits), "repeated"))
    tested = with_hits(table, filter_words, "h", filter_bits)
    alone = tested.filter(~F.col("__possibly_repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    hits = tested.filter("__possibly_repeated").select("doc_id", "sha", "row")
    # rows of one text that also share the largest id: the last of them stays
    groups = hits.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "groups")
    # A hot text meets its group by broadcast, so its rows don't go to one task; such groups are at most 1 / HOT_ROWS of the rows.
    hot = maybe_broadcast(written(groups.filter(F.col("group_size") >= HOT_ROWS), "hot-groups"))
    joined = hits.join(hot, "sha").unionByName(hits.join(hot, "sha", "left_anti").join(groups.hint("merge"), "sha"))
    settled = joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
    return alone.unionByName(settled).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Rows that the filter misses never shuffle."""
    sha = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    # the row travels as one column, so that no name of it can clash
    marked = df.select(F.struct("*").alias("kept"), F.col(id_col).alias("id"), sha.alias("sha")).withColumn("h", F.xxhash64("sha"))
    table = written(marked.select("h"), "hashes")
    filter_words = maybe_broadcast(written(repeated_filter(table), "repeated"))
    tested = with_hits(marked, filter_words)
    hits = tested.filter("__possibly_repeated").select("kept", "id", "sha")
    winners = hits.groupBy("sha").agg(F.max("id").alias("keep")).withColumnRenamed("sha", "of")
    stay = hits.join(winners, (F.col("sha") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    # combined in each task first, so that rows repeated with id and text don't meet in one
    stay = stay.dropDuplicates(["sha", "id"])
    return tested.filter(~F.col("__possibly_repeated")).select("kept.*").unionByName(stay.select("kept.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
