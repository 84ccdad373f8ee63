"""Eligible messages, truncation to complete conversations, and question-answer pairs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eligible(messages: DataFrame, as_of: datetime.datetime | None = None, days: int | None = None, workspace_id: int | None = None, agent_id: str | None = None) -> DataFrame:
    """User and assistant messages with text; the optional filters reach the scan."""
    keep: list[Column] = [F.col("role").isin("user", "assistant"), F.trim("content_text") != ""]
    if as_of is not None and days is not None:
        keep.append(F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=days)).cast("timestamp_ntz"))
    if workspace_id is not None:
        keep.append(F.col("workspace_id") == workspace_id)
    if agent_id is not None:
        keep.append(F.col("agent_id") == agent_id)
    condition = keep[0]
    for k in keep[1:]:
        condition = condition & k
    return messages.filter(condition)


def truncated(messages: DataFrame, conversation: str, at: str, limit: int) -> DataFrame:
    """The newest conversations whose messages fit into ``limit`` together, whole, and the newest in any case.

    The running sum has one row a conversation; its prefix below the limit is all that one task sorts.
    """
    stats = messages.groupBy(conversation).agg(F.max(at).alias("__last"), F.count(F.lit(1)).alias("__n"))
    # No more than ``limit`` conversations can fit, as each has a message.
    newest = stats.orderBy(F.desc_nulls_last("__last"), F.desc(conversation)).limit(limit + 1)
    order = Window.orderBy(F.desc_nulls_last("__last"), F.desc(conversation))
    kept = newest.withColumn("__sum", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rank", F.row_number().over(order))
    return messages.join(kept.filter((F.col("__sum") <= limit) | (F.col("__rank") == 1)).select(conversation), conversation, "left_semi")


def truncation_metrics(found: DataFrame, kept: DataFrame, conversation: str) -> DataFrame:
    """One row: messages and conversations found and processed, and the share that was cut off."""
    a = found.agg(F.count(F.lit(1)).alias("messages_found"), F.count_distinct(conversation).alias("conversations_found"))
    b = kept.agg(F.count(F.lit(1)).alias("messages_processed"), F.count_distinct(conversation).alias("conversations_processed"))
    ratio = F.when(F.col("messages_found") > 0, F.round(1 - F.col("messages_processed") / F.col("messages_found"), 4)).otherwise(0.0)
    return a.crossJoin(F.broadcast(b)).withColumn("truncated", F.col("messages_processed") < F.col("messages_found")).withColumn("truncated_ratio", ratio)


def with_next(messages: DataFrame, conversation: str, order: list[str], text: str = "content_text") -> DataFrame:
    w = Window.partitionBy(conversation).orderBy(*order)
    talk = messages.filter(F.col("role").isin("user", "assistant") & (F.trim(text) != "") & F.col(conversation).isNotNull())
    return talk.withColumn("__role", F.lead("role").over(w)).withColumn("__text", F.lead(text).over(w)).withColumn("__pk", F.lead(order[-1]).over(w))


def pairs(messages: DataFrame, conversation: str, order: list[str], text: str = "content_text") -> DataFrame:
    """Each question with the reply that follows it directly: a later question replaces one that waits, further replies are ignored."""
    found = with_next(messages, conversation, order, text).filter("role = 'user' AND __role = 'assistant'")
    return found.withColumn("user_text", F.trim(text)).withColumn("assistant_text", F.trim("__text")).withColumnRenamed("__pk", "assistant_pk").drop("__role", "__text", text, "role")


def pair_stats(messages: DataFrame, conversation: str, order: list[str], text: str = "content_text") -> DataFrame:
    found = with_next(messages, conversation, order, text)
    return found.agg(
        F.count_if((F.col("role") == "user") & (F.col("__role") == "assistant")).alias("pairs"),
        F.count_if((F.col("role") == "user") & (F.coalesce("__role", F.lit("user")) == "user")).alias("unanswered"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
    )
