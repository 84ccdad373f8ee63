"""A chat dump derived from the provided tables: raw workspaces, agents, chats, messages and FAQs.

``conversations`` stands for messages and chats, ``benchmark`` for FAQs. The derivation is deterministic and covers
each case of the transforms: workspaces with none, one and two agents, all shapes of message JSON, FAQs without
agent, without answer, and deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _started(conv):
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({conv} as int), 0, 0)")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def raw_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select(F.expr("conv_id % 7").alias("id")).distinct().selectExpr(
        "id", "concat('ws-', id) AS name", "concat('cat-', id % 3) AS category", "CASE WHEN id = 3 THEN NULL ELSE id <> 5 END AS active",
        "timestamp_ntz'2023-01-01 00:00:00' AS created_at", "CASE WHEN id = 6 THEN timestamp_ntz'2024-06-01 00:00:00' END AS deleted_at",
    )


def raw_agents(spark: SparkSession) -> DataFrame:
    """One agent in workspaces 0 to 3, two in 4 and 5, none in 6, and one of an unknown workspace."""
    rows = [(w, k) for w in range(6) for k in range(2 if w >= 4 else 1)] + [(99, 0)]
    return spark.createDataFrame(rows, "workspace_id long, k int").selectExpr(
        "concat('agent-', workspace_id, '-', k) AS id", "workspace_id", "concat('Agent ', k) AS name", "CASE WHEN k = 1 THEN timestamp_ntz'2024-05-01 00:00:00' END AS deleted_at"
    )


def raw_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id").distinct().select(
        F.concat(F.lit("chat-"), F.col("conv_id")).alias("id"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("conversation_id"), F.expr("conv_id % 7").alias("workspace_id"),
        F.concat(F.lit("m"), F.expr("conv_id % 3")).alias("model"), F.expr("CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE concat('300', conv_id) END").alias("phone"),
        _started("conv_id").alias("created_at"), F.expr("CAST(NULL AS timestamp_ntz)").alias("updated_at"), "conv_id",
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose JSON has the shape of ``conv_id % 8``."""
    part = "array(named_struct('type', 'text', 'text', {}))"
    shapes = [
        f"to_json(named_struct('role', role, 'content', {part.format('named_struct(' + repr('value') + ', text)')}))",
        f"to_json(named_struct('role', upper(role), 'content', {part.format('text')}))",
        "to_json(named_struct('role', role, 'content', text))",
        "to_json(named_struct('role', role, 'content', named_struct('text', named_struct('value', text))))",
        "to_json(named_struct('role', role, 'text', text))",
        "to_json(named_struct('role', role, 'message', text))",
        "to_json(named_struct('role', role, 'content', array()))",
        "to_json(named_struct('role', role))",
    ]
    message = "CASE conv_id % 8 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END"
    return conversations(spark, sf_dir).select(
        F.concat(F.lit("msg-"), F.expr("conv_id * 100 + turn")).alias("id"), F.concat(F.lit("chat-"), F.col("conv_id")).alias("agent_chat_id"), F.expr(message).alias("message"),
        F.expr("CASE WHEN turn % 3 = 0 THEN 'note' ELSE 'text' END").alias("message_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)").alias("created_at"),
        F.expr("conv_id * 100 + turn").alias("message_pk"), F.col("conv_id"), F.col("turn"),
    )


def raw_faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr(
        "concat('faq-', item_id) AS id", "concat('agent-', item_id % 7, '-0') AS agent_id", "text AS question", "CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 5 = 1 THEN ' ' ELSE concat('R. ', text) END AS answer",
        "CASE WHEN item_id % 4 = 0 THEN timestamp_ntz'2024-02-01 00:00:00' END AS deleted_at",
    )


#: The same tables as common table expressions of DuckDB, without the JSON: its text is known from the shape.
SQL = """
raw_workspaces AS (SELECT DISTINCT conv_id % 7 AS id, 'ws-' || (conv_id % 7) AS name, 'cat-' || (conv_id % 7 % 3) AS category,
  CASE WHEN conv_id % 7 = 3 THEN NULL ELSE conv_id % 7 <> 5 END AS active, CASE WHEN conv_id % 7 = 6 THEN TIMESTAMP '2024-06-01' END AS deleted_at FROM conversations),
raw_agents AS (SELECT 'agent-' || w || '-' || k AS id, w AS workspace_id, 'Agent ' || k AS name, CASE WHEN k = 1 THEN TIMESTAMP '2024-05-01' END AS deleted_at
  FROM (SELECT w, k FROM range(6) a(w), range(2) b(k) WHERE k = 0 OR w >= 4 UNION ALL SELECT 99, 0)),
raw_chats AS (SELECT DISTINCT conv_id, 'chat-' || conv_id AS id, 'conv-' || conv_id AS conversation_id, conv_id % 7 AS workspace_id, 'm' || (conv_id % 3) AS model,
  CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE '300' || conv_id END AS phone, TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR AS created_at FROM conversations),
raw_messages AS (SELECT conv_id, turn, 'msg-' || (conv_id * 100 + turn) AS id, conv_id * 100 + turn AS message_pk, 'chat-' || conv_id AS agent_chat_id, role,
  CASE WHEN turn % 3 = 0 THEN 'note' ELSE 'text' END AS message_type, TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS created_at,
  CASE WHEN conv_id % 8 < 6 THEN nullif(trim(text, ' '), '') END AS content_text, conv_id % 8 AS shape FROM conversations),
raw_faqs AS (SELECT 'faq-' || item_id AS id, 'agent-' || (item_id % 7) || '-0' AS agent_id, text AS question,
  CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 5 = 1 THEN ' ' ELSE 'R. ' || text END AS answer, CASE WHEN item_id % 4 = 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM benchmark)
"""
