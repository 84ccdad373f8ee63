"""From documents to packed training sequences: the stages, and their run from end to end.

Each stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurq.llm import decontaminate, exact_dedup, language_id, packing, simhash
from recurq.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter, null texts included, go."""
    model = language_id.train(docs)
    taken = max(map(len, docs.columns))
    said = "language".ljust(taken + 1, "_")  # longer than any name of docs
    marked = language_id.with_language(docs, model, into=(said, "score".ljust(taken + 1, "_")))
    return marked.filter(F.col(said) != language_id.UNDETERMINED).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id; of rows that share both, one. Null counts as empty."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least id. Texts without a word are near copies of each other."""
    return simhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; without a word in the items, all."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins and offsets; rows that repeat are packed each."""
    return packing.best_fit(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("packed", packed)]

#: SQL can't express the stages that learn, hash to bits or pack; the test has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
