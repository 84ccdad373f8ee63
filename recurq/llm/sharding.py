"""Contiguous shards of nearly equal size, by a global prefix sum of byte sizes from per-partition totals.

Rows are put in order of id (then size and checksum, so that ties have an order), in range partitions of
fixed-size rows: id, size and checksum, never text. Each partition's totals are summed, the totals'
running sums give each partition its offset, and a running sum within the partition does the rest. A row
belongs to the shard in whose equal share of all bytes its middle byte falls, which cuts at equal targets
and keeps shards contiguous: a shard's size is off its target by one row's size at most.

Only the per-partition totals meet in one place; their number is the number of partitions. The law is
``bytes``.

Cases: null text has size 1 and checksum 0; null ids come first; repeated rows each have a slot; an
empty table gives an empty result; a row larger than a share leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import text_of, written


def shard_by_bytes(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(text_col)
    sized = written(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    order = ["doc_id", "size", "text_crc32"]
    ranged = written(sized.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("total"),
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(
        ranged.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(running) - F.col("size"))
        .withColumn("at", F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        .select("doc_id", "size", "text_crc32", "at", F.expr(f"least({shards - 1}, (2 * start + size) * {shards} div (2 * total))").cast("int").alias("shard")),
        "placed",
    )
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 in SQL: the 256-entry table from its rule (polynomial 0xEDB88320), then one step a byte.
ORACLE = """
WITH step AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)),
sized AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
summed AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || p)::BIGINT FOR p IN regexp_extract_all(hex(encode(text)), '..')]),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM sized, step),
placed AS (
  SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total, row_number() OVER w - 1 AS pos
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least(15, (2 * start + size) * 16 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
