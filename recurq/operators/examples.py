"""Evidence of a candidate: examples once each, their ranking, the agent and the answer most often seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.functions import text as T
from recurq.sources.shared import written

UNSURE = "La informacion disponible no es suficiente para publicar una respuesta definitiva; se debe confirmar el procedimiento con el equipo responsable."


def first_examples(df: DataFrame, keys: list[str], text: str, position: str, most: int = 3) -> DataFrame:
    """The first ``most`` different examples of each group, and how many repeats came before the last of them.

    Repeats after the last example that is taken don't count.
    """
    clean = df.withColumn("example", T.clean_question_evidence(text)).filter("example <> ''").withColumn("__q", T.normalize_question("example"))
    once = clean.groupBy(*keys, "__q").agg(F.min(position).alias("__at"), F.min_by("example", position).alias("example"))
    taken = once.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))).filter(F.col("__n") <= most)
    lists = taken.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "example"))), lambda x: x["example"]).alias("examples"), F.max("__at").alias("__last"), F.count(F.lit(1)).alias("__k"))
    seen = clean.select(*keys, F.col(position).alias("__p")).join(lists, keys).groupBy(*keys).agg(F.any_value("examples").alias("examples"), F.any_value("__k").alias("k"), F.count_if((F.col("__p") <= F.col("__last")) | (F.col("__k") < most)).alias("n"))
    return seen.select(*keys, "examples", (F.col("n") - F.col("k")).alias("duplicates"))


def ranked_examples(df: DataFrame, keys: list[str], question: Column, text: str, similarity: str, position: str, most: int = 3) -> DataFrame:
    """The best ``most`` examples of each group: by shared tokens with the question, similarity, then earlier position."""
    clean = df.withColumn("__question", T.support_tokens(question)).withColumn("example", T.clean_question_evidence(text)).filter("example <> ''").withColumn("__q", T.normalize_question("example"))
    first = clean.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__q").orderBy(position))).filter("__n = 1")
    overlap = F.size(F.array_intersect("__question", T.support_tokens("example")))
    rank = Window.partitionBy(*keys).orderBy(F.desc("overlap"), F.desc(similarity), position, F.desc("example"))
    return first.withColumn("overlap", overlap).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most).select(*keys, "example", "overlap", "rank")


def most_frequent(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The value seen most often in each group, the first seen on a tie; nulls don't count."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return n.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*keys, value, "n")


def most_common_answer(df: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """The cleaned answer of 25 characters or more that is most common in each group, or a fixed sentence."""
    clean = written(df.select(*keys, position, T.clean_faq_answer(answer).alias("answer")), "answers")
    found = most_frequent(clean.filter(F.char_length("answer") >= 25), keys, "answer", position)
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("answer", F.lit(UNSURE)).alias("answer"))
