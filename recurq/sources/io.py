"""Readers, keyed upserts and appends. Plain Parquet has no MERGE: an upsert writes a new version and swaps to it."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.sources.shared import written

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def valid_name(name: str) -> str:
    """A schema or table name that is safe in an identifier, or an error."""
    if not _NAME.match(name or ""):
        raise ValueError(f"not a valid name: {name!r}")
    return name


def require_tables(spark: SparkSession, namespace: str, tables: Sequence[str]) -> None:
    """An error that names every table the catalog lacks."""
    missing = [t for t in tables if not spark.catalog.tableExists(f"{valid_name(namespace)}.{valid_name(t)}")]
    if missing:
        raise LookupError(f"missing tables in {namespace}: {', '.join(missing)}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A JDBC table, read in ``parts`` ranges of ``key`` when its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary_json(row: DataFrame) -> str:
    """A one-row frame as a JSON document."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a summary has one row")
    return json.dumps(found[0].asDict(recursive=True), ensure_ascii=False, default=str)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], pk: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; ``new`` has each key once.

    With ``pk``, a surrogate key that ``new`` lacks, rows that exist keep theirs and new ones get the next numbers in
    the order of their keys, without a task that sees them all.
    """
    if pk:
        known = new.join(old.select(*keys, pk), list(keys), "left")
        top = old.agg(F.coalesce(F.max(pk), F.lit(0)).cast("long").alias("__top"))
        # ranges of keys are numbered by themselves; a row a range tells how many come before it
        ranged = written(known.filter(F.col(pk).isNull()).drop(pk).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "fresh")
        sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
        starts = sizes.withColumn("__before", before).drop("n").crossJoin(top)
        number = F.col("__top") + F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
        fresh = ranged.join(F.broadcast(starts), "__part").withColumn(pk, number).drop("__top", "__before", "__part")
        new = known.filter(F.col(pk).isNotNull()).unionByName(fresh)
    stay = old.join(new.select(*keys), list(keys), "left_anti")
    return stay.unionByName(new, allowMissingColumns=True)


def append_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; null keys are equal."""
    marked = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [new[k].eqNullSafe(marked[f"__{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return old.unionByName(new.join(marked, condition, "left_anti"), allowMissingColumns=True)


def unpivot_metrics(one_row: DataFrame) -> DataFrame:
    """(metric_name, metric_value) of a one-row frame of numbers."""
    return one_row.select([F.col(c).cast("double").alias(c) for c in one_row.columns]).unpivot([], one_row.columns, "metric_name", "metric_value")


def replace_table(df: DataFrame, path: str, spark: SparkSession) -> str:
    """Write a new version of a table under ``path`` and point readers at it; return the version's folder.

    Readers take the newest version that was written whole, so a run that dies leaves the old one in force.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(str(s.getPath().getName())[1:]) for s in fs.listStatus(hadoop) if str(s.getPath().getName())[:1] == "v") if fs.exists(hadoop) else []
    target = f"{path}/v{(versions[-1] if versions else 0) + 1:08d}"
    df.write.parquet(target)
    return target


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a version of a table was written whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")) for s in fs.listStatus(hadoop))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = sorted(str(s.getPath()) for s in fs.listStatus(hadoop) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")))
    return spark.read.parquet(whole[-1])
