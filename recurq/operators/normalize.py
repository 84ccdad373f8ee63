"""Raw chat dump to clean tables: roles, text from JSON, agent inference, upsert inputs, data-quality issues."""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recurq.functions import lexicon as L

ROLES = ["user", "assistant", "system", "tool"]


def role_of(message: Column) -> Column:
    role = F.lower(F.get_json_object(message, "$.role"))
    return F.when(role.isin(ROLES), role).otherwise(F.lit("unknown"))


def _scalar(v: Column, path: str) -> Column:
    """A leaf as text; objects and arrays are no text."""
    leaf = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(leaf)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, path, "string"))


def _string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


_PART_PATHS = ("$.text.value", "$.text", "$.input_text.text", "$.output_text.text", "$.content.text", "$.content", "$.value", "$.transcript")
_WHOLE_PATHS = ("$.content", "$.content.text.value", "$.content.text", "$.text", "$.message", "$.value")


def content_text(message: Column) -> Column:
    """The text of a message: its parts, one a line, else the first of the known paths; blank is null."""
    v = F.try_parse_json(message)
    parts = F.try_variant_get(v, "$.content", "array<variant>")
    texts = F.transform(parts, lambda p: F.nullif(F.trim(F.coalesce(*[(_string if path == "$.text" else _scalar)(p, path) for path in _PART_PATHS])), F.lit("")))
    joined = F.when(F.size(F.filter(texts, lambda t: t.isNotNull())) > 0, F.array_join(texts, "\n"))
    whole = [(_string if path == "$.content" else _scalar)(v, path) for path in _WHOLE_PATHS]
    return F.nullif(F.trim(F.coalesce(joined, *whole)), F.lit(""))


def extraction_status(message: Column, text: Column) -> Column:
    v = F.try_parse_json(message)
    parts = F.try_variant_get(v, "$.content", "array<variant>")
    known = F.array_contains(F.json_object_keys(message), "content")
    return (
        F.when(text.isNotNull(), "extracted").when(parts.isNotNull(), F.when(F.size(parts) == 0, "empty").otherwise("failed")).when(~F.coalesce(known, F.lit(False)), "empty").otherwise("failed")
    )


def messages(raw: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages of known chats, with role, text and status."""
    text = content_text(F.col("message"))
    found = raw.join(chats.select(F.col("id").alias("agent_chat_id"), "workspace_id"), "agent_chat_id")
    found = found.withColumn("role", role_of(F.col("message"))).withColumn("content_text", text)
    found = found.withColumn("extraction_status", extraction_status(F.col("message"), F.col("content_text")))
    notes = F.when(F.col("extraction_status") == "empty", "message has no content").when(F.col("extraction_status") == "failed", "content has no known text path")
    return found.withColumn("extraction_notes", notes)


def workspaces(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("workspace_id"), "name", "category", (F.coalesce("active", F.lit(True)) & F.col("deleted_at").isNull()).alias("active"))


def agents(raw: DataFrame, known_workspaces: DataFrame) -> DataFrame:
    """Agents of known workspaces. Workspaces are far fewer than messages; the optimizer broadcasts by size."""
    return raw.join(known_workspaces.select("workspace_id"), "workspace_id").select(F.col("id").alias("agent_id"), "workspace_id", "name", F.col("deleted_at").isNull().alias("active"))


def phone_mask(phone: Column) -> Column:
    return F.when(F.trim(phone) != "", F.concat(F.lit("md5:"), F.md5(phone)))


def conversations(chats: DataFrame, raw_messages: DataFrame, known_agents: DataFrame) -> DataFrame:
    """Chats with their bounds and the agent inferred from how many the workspace has. Both sides are aggregated first."""
    bounds = raw_messages.groupBy(F.col("agent_chat_id").alias("id")).agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    counts = known_agents.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.min("agent_id").alias("one"))
    joined = chats.join(counts, "workspace_id", "left").join(bounds, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        F.col("id").alias("source_agent_chat_id"), "conversation_id", "workspace_id", F.when(n == 1, F.col("one")).alias("agent_id"), "model",
        phone_mask(F.col("phone")).alias("phone_hash"), F.coalesce("first_at", "created_at").alias("started_at"), F.coalesce("last_at", "updated_at", "created_at").alias("ended_at"),
        F.when(n == 1, "workspace_single_agent").when(n == 0, "no_agent_for_workspace").otherwise("multiple_agents_for_workspace").alias("agent_inference_method"),
        F.when(n == 1, 1.0).when(n == 0, 0.0).otherwise(0.4).cast("decimal(4,3)").alias("agent_inference_confidence"),
        F.when(n == 0, "the workspace has no agent").when(n > 1, "the workspace has several agents").alias("agent_inference_notes"),
    )


def existing_faqs(raw: DataFrame, known_agents: DataFrame) -> DataFrame:
    """FAQs, those of unknown agents too, with a null agent and workspace."""
    known = known_agents.select("agent_id", "workspace_id")
    return raw.withColumnRenamed("agent_id", "source_agent_id").join(known, F.col("source_agent_id") == F.col("agent_id"), "left").select(
        F.col("id").alias("faq_id"), "source_agent_id", "agent_id", "workspace_id", "question", "answer", F.col("deleted_at").isNull().alias("is_active")
    )


def issue(source: DataFrame, table: str, key: str, kind: str, severity: Column | str, details: dict[str, Column]) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    body = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])) if details else F.lit("{}")
    return source.select(F.lit(table).alias("source_table"), F.col(key).cast("string").alias("source_pk"), F.lit(kind).alias("issue_type"), severity.alias("severity"), body.alias("details"))


def issues(convs: DataFrame, faqs: DataFrame, msgs: DataFrame) -> DataFrame:
    """The three data-quality rules."""
    return (
        issue(convs.filter("agent_id IS NULL"), "agent_chats", "source_agent_chat_id", "agent_not_inferred", "warning", {"workspace_id": F.col("workspace_id"), "method": F.col("agent_inference_method")})
        .unionByName(issue(faqs.filter("agent_id IS NULL"), "agent_faqs", "faq_id", "missing_agent_reference", "warning", {"agent_id": F.col("source_agent_id")}))
        .unionByName(issue(msgs.filter("content_text IS NULL"), "chat_messages", "id", "message_text_not_extracted", F.when(F.col("extraction_status") == "empty", "info").otherwise("warning"), {"role": F.col("role"), "status": F.col("extraction_status")}))
    )


def raw_scan(raw: DataFrame, chats: DataFrame, raw_workspaces: DataFrame, raw_agents: DataFrame, since: datetime.datetime, workspace_id: int | None = None, agent_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Raw messages since a time with their chat and company name, those of a workspace or of the workspaces of an agent.

    With ``limit``, the first rows by workspace, chat, time and id; without, rows come in no order, as sorting all of
    them has no use to a table. Messages of unknown chats are left out, those of unknown workspaces stay.
    """
    of = chats.select(F.col("id").alias("agent_chat_id"), "workspace_id", "conversation_id", "model")
    if workspace_id is not None:
        of = of.filter(F.col("workspace_id") == workspace_id)
    if agent_id:
        of = of.join(raw_agents.filter(F.col("id").cast("string") == agent_id).select("workspace_id"), "workspace_id", "left_semi")
    found = raw.filter(F.col("created_at") >= F.lit(since)).select(F.col("id").alias("message_id"), "message", "created_at", "agent_chat_id", "message_type").join(of, "agent_chat_id")
    found = found.join(raw_workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("company_name")), "workspace_id", "left")
    return found if limit is None else found.orderBy("workspace_id", "agent_chat_id", "created_at", "message_id").limit(limit)


def first_text(value: object) -> str:
    """The first text in a JSON value: lists give all of theirs, objects that of the first known path with any."""
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, list):
        return " ".join(t for t in map(first_text, value) if t)
    if isinstance(value, dict):
        for path in L.MESSAGE_PATHS:
            inner: object = value
            for name in path.split("."):
                inner = inner.get(name) if isinstance(inner, dict) else None
            if text := first_text(inner):
                return text
    return ""


def dry_run_text(message: str | None) -> str:
    """The text of a raw message as a dry run sees it: parts of known types in one line; what is not JSON is text itself."""
    try:
        value = json.loads(message or "null")
    except (ValueError, RecursionError):
        value = message
    content = value.get("content") if isinstance(value, dict) else None
    if isinstance(content, list):
        return first_text([p for p in content if not isinstance(p, dict) or p.get("type") in L.PART_TYPES])
    return first_text(content) or first_text(value)


@F.pandas_udf(StringType())
def dry_run_texts(message: pd.Series) -> pd.Series:
    """``dry_run_text`` in Arrow batches: JSON nests to any depth, which no fixed expression follows."""
    return message.map(dry_run_text)


def skip_reason(message: Column) -> Column:
    """Why a raw message gives no row in a dry run: not JSON, another role, or no text; null if it does."""
    role = F.lower(F.get_json_object(message, "$.role"))
    return (
        F.when(F.try_parse_json(message).isNull(), "invalid_json").when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "unsupported_role").when(content_text(message).isNull(), "empty_text")
    )
