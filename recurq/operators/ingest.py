"""Raw to clean: the five keyed upserts of one ingest, over all rows or those of a workspace, an agent or a time on.

Cases: a table that does not exist yet is made; a second ingest of the same rows changes nothing; rows whose key
is null are left out; of rows that share a key any one is taken, the same in every run.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recurq.operators import normalize
from recurq.sources import io
from recurq.sources.shared import written

#: The key of each clean table and its surrogate key.
TABLES = {
    "workspaces": (["workspace_id"], "workspace_pk"),
    "agents": (["agent_id"], "agent_pk"),
    "conversations": (["source_agent_chat_id"], "conversation_pk"),
    "messages": (["id"], "message_pk"),
    "faqs": (["faq_id"], "faq_pk"),
}


def selected(tables: dict[str, DataFrame], workspace_id: int | str | None = None, agent_id: str | None = None, since: datetime.datetime | None = None) -> dict[str, DataFrame]:
    """The rows of clean tables that an ingest by workspace, agent or time takes; a table without the column keeps all.

    By agent, agents and FAQs are the agent's own, and conversations, messages and workspaces those of its workspaces, if the
    tables have ``agents``; without that table, rows that have an agent are its own and others stay.
    """
    out = {}
    at_work = tables["agents"].filter(F.col("agent_id") == agent_id).select("workspace_id") if agent_id is not None and "agents" in tables else None
    for name, df in tables.items():
        if workspace_id is not None and "workspace_id" in df.columns:
            df = df.filter(F.col("workspace_id") == workspace_id)
        own = name in ("agents", "faqs") or at_work is None
        if agent_id is not None and own and "agent_id" in df.columns:
            df = df.filter(F.col("agent_id") == agent_id)
        elif at_work is not None and not own and "workspace_id" in df.columns:
            df = df.join(at_work, "workspace_id", "left_semi")
        if since is not None and name == "messages":
            df = df.filter(F.col("created_at") >= F.lit(since))
        out[name] = df
    return out


#: What the messages of an ingest are counted by, beside what every table is: rows that are skipped come in, without a text.
MESSAGE_COUNTS = ("user_messages", "assistant_messages", "messages_skipped_invalid_json", "messages_skipped_empty_text")


def _message_counts() -> dict[str, Column]:
    reason, role = normalize.skip_reason(F.col("message")), F.col("role")
    return dict(zip(MESSAGE_COUNTS, (role == "user", role == "assistant", reason == "invalid_json", reason == "empty_text"), strict=True))


def _one_a_key(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """One row a key, written, and what was counted on the way.

    Counts go through the shuffle as columns of the groups and are observed where the groups are written: no second scan, and a
    map task that runs again is not counted again.
    """
    value = F.max(F.struct(*[F.col(c) for c in rows.columns if c not in keys])).alias("__row")
    grouped = rows.groupBy(*keys).agg(value, F.count(F.lit(1)).alias("__n"), *[F.count_if(c).alias(f"__n_{name}") for name, c in counts.items()])
    has_key = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    seen = Observation()
    grouped = grouped.observe(
        seen, total("__n").alias("read"), F.count_if(has_key).alias("written"), total(F.when(has_key, F.col("__n") - 1)).alias("duplicates"),
        *[total(f"__n_{name}").alias(name) for name in counts],
    )
    out = written(grouped.filter(has_key).select(*keys, "__row.*"), "once")
    return out, seen.get


def ingest(old: dict[str, DataFrame], new: dict[str, DataFrame], counts: dict[str, dict[str, int]] | None = None) -> dict[str, DataFrame]:
    """Clean tables after ``new`` rows, without surrogate keys, are put into ``old`` ones.

    ``counts`` gets, by table, how many rows were ``read``, ``written`` and ``duplicates`` of a key; for messages that still
    have the raw ``message``, those of ``MESSAGE_COUNTS``, too.
    """
    out = dict(old)
    for name, rows in new.items():
        keys, pk = TABLES[name]
        rows = rows.drop(pk)
        more = _message_counts() if counts is not None and name == "messages" and {"message", "role"} <= set(rows.columns) else {}
        rows, seen = _one_a_key(rows, keys, more)
        if counts is not None:
            counts[name] = seen
        before = old.get(name)
        before = rows.limit(0).withColumn(pk, F.lit(None).cast("long")) if before is None else before
        out[name] = io.upsert(before, rows, keys, pk)
    return out


def figures(counts: dict[str, dict[str, int]], pairs: int | None = None) -> dict[str, int]:
    """The counters of an ingest: rows read by table, messages by role and reason, and what was written or left out of all."""
    read = {"chats" if name == "conversations" else name: c["read"] for name, c in counts.items()}
    out = {f"{name}_read": read.get(name, 0) for name in ("workspaces", "agents", "chats", "messages", "faqs")}
    out |= {name: counts.get("messages", {}).get(name, 0) for name in MESSAGE_COUNTS}
    of_all = lambda key: sum(c[key] for c in counts.values())
    out |= {"duplicates_omitted": of_all("duplicates"), "records_written": of_all("written"), "records_omitted": of_all("read") - of_all("written")}
    return out if pairs is None else out | {"user_assistant_pairs_built": pairs}
