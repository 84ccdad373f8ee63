"""The fifteen validation reports over raw and clean tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.functions import text as T


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in tables.items()])


def workspace_activity(w: DataFrame, a: DataFrame, c: DataFrame, m: DataFrame) -> DataFrame:
    """Distinct agents and conversations, and messages once for each agent, as a join of all four would count them.

    Each side is aggregated by itself; the product with the number of agents stands for the join's fan-out.
    """
    agents = a.groupBy("workspace_id").agg(F.count_distinct("agent_id").alias("agents_count"))
    convs = c.groupBy("workspace_id").agg(F.count_distinct("conversation_pk").alias("conversations_count"))
    msgs = m.join(c.select("conversation_pk", "workspace_id"), "conversation_pk").groupBy("workspace_id").agg(F.count("message_pk").alias("n"))
    j = w.join(agents, "workspace_id", "left").join(convs, "workspace_id", "left").join(msgs, "workspace_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*w.columns, zero("agents_count").alias("agents_count"), zero("conversations_count").alias("conversations_count"), (zero("n") * F.greatest(zero("agents_count"), F.lit(1))).alias("messages_count"))


def group_counts(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def role_status(m: DataFrame) -> DataFrame:
    return m.groupBy("role", "extraction_status").agg(F.count(F.lit(1)).alias("messages_count"), F.count_if(F.col("content_text").isNull()).alias("without_text"))


def untexted(m: DataFrame, c: DataFrame, most: int = 100) -> DataFrame:
    found = m.filter("content_text IS NULL").join(c.select("conversation_pk", "source_agent_chat_id", F.col("workspace_id").alias("ws"), "agent_id"), "conversation_pk")
    return found.orderBy(F.asc_nulls_last("created_at"), "message_pk").limit(most).select("message_pk", "source_agent_chat_id", F.col("ws").alias("workspace_id"), "agent_id", "role", "message_type", "extraction_status")


def faq_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("workspace_id", "agent_id", "source_agent_id").agg(
        F.count(F.lit(1)).alias("total_faqs"), F.count_if("is_active").alias("active_faqs"), F.count_if(~F.col("is_active")).alias("deleted_faqs"),
        F.count_if(F.trim(F.coalesce("answer", F.lit(""))) == "").alias("faqs_without_answer"),
    )


def windows(c: DataFrame) -> DataFrame:
    return c.groupBy("workspace_id", "agent_id").agg(F.count(F.lit(1)).alias("conversations_count"), F.min("started_at").alias("first_started_at"), F.max("ended_at").alias("last_ended_at"))


def duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("duplicates")).filter("duplicates > 1").select(F.lit(name).alias("key_name"), F.col(key).cast("string").alias("key_value"), "duplicates")


def missing(child: DataFrame, parent: DataFrame, on: str, name: str) -> DataFrame:
    """One row: how many children have no parent. Null keys have none."""
    return child.join(parent.select(on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")


def repeated_questions(texts: DataFrame, text: str, least: int = 3, shortest: int = 3, most: int = 100) -> DataFrame:
    """Texts that repeat after folding white space and case, the most frequent first.

    Equal texts combine on the map side, so a hot text is one row a task; the top rows are taken in each task.
    """
    normal = F.trim(F.regexp_replace(F.lower(text), F.lit(r"\s+"), F.lit(" ")))
    found = texts.filter(F.col(text).isNotNull()).select(normal.alias("question")).filter(F.length("question") >= shortest)
    counted = found.groupBy("question").agg(F.count(F.lit(1)).alias("repetitions")).filter(F.col("repetitions") >= least)
    return counted.orderBy(F.desc("repetitions"), "question").limit(most)


def token_counts(df: DataFrame, keys: list[str], text: str, position: str, most: int = 4) -> DataFrame:
    """The most frequent support tokens of each group, the first seen first on a tie."""
    from pyspark.sql.window import Window

    tokens = df.select(*keys, F.col(position).alias("p"), F.posexplode(T.support_tokens(text)).alias("i", "token"))
    n = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "i")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*keys, "token", "n", "rank")
