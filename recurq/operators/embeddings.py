"""Embeddings kept by message, model and text: only what a store lacks is encoded.

Cases: a null key or text has no embedding, nor has a text whose vector is zero or missing; of rows that share a key any
one is taken, the same in every run; a message whose text has changed is encoded again, and its old row is never met, as
the digest of the text is part of the key; another model encodes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurq.sources.shared import written

KEY = ["message_pk", "embedding_model", "text_md5"]


def keyed(messages: DataFrame, text: str, model: str) -> DataFrame:
    """One row a message with the key of its embedding."""
    rows = messages.dropna(subset=["message_pk", text])
    rest = [c for c in rows.columns if c != "message_pk"]
    rows = rows.groupBy("message_pk").agg(F.max(F.struct(text, *[c for c in rest if c != text])).alias("__row")).select("message_pk", "__row.*")
    return rows.withColumn("embedding_model", F.lit(model)).withColumn("text_md5", F.md5(text))


def unseen(messages: DataFrame, stored: DataFrame | None, text: str, model: str) -> DataFrame:
    """Messages whose embedding by ``model`` is not in ``stored``. Keys only are read of ``stored``."""
    rows = keyed(messages, text, model)
    if stored is None:
        return rows
    # both sides hash by the key; the model is a constant, so rows of other models never reach the shuffle
    return rows.join(stored.filter(F.col("embedding_model") == model).select(*KEY), KEY, "left_anti")


def encoded(rows: DataFrame, vector: Column, extra: list[str] | None = None) -> DataFrame:
    """Rows for the table of embeddings: those that have a vector other than zero."""
    found = rows.withColumn("embedding", vector)
    some = F.exists("embedding", lambda x: (x != 0) & ~F.isnan(x))
    return found.filter(F.coalesce(some, F.lit(False))).select(*KEY, F.size("embedding").alias("embedding_dimension"), "embedding", *(extra or []))


def with_embeddings(messages: DataFrame, stored: DataFrame, text: str, model: str) -> DataFrame:
    """Messages with their stored ``embedding``; null where there is none."""
    of_model = stored.filter(F.col("embedding_model") == model).select(*KEY, "embedding")
    found = messages.withColumn("embedding_model", F.lit(model)).withColumn("text_md5", F.md5(text)).join(of_model, KEY, "left")
    return found.drop("embedding_model", "text_md5")


def delta(messages: DataFrame, stored: DataFrame | None, text: str, model: str, vector: Column, extra: list[str] | None = None) -> DataFrame:
    """The rows that the table of embeddings lacks, written: what is appended is what was encoded."""
    return written(encoded(unseen(messages, stored, text, model), vector, extra), "embeddings")
