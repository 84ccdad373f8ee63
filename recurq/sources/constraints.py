"""The clean tables' rules, and the rows that break them.

Parquet has no constraints. ``TABLES`` is the registry: columns with types, primary and unique keys, partial unique
keys, checks and foreign keys; ``schema_of`` gives a table's Spark schema, and ``violations`` compiles the rules of all
tables that are given to one frame of what breaks them. Rules that a row breaks by itself are found in one scan of
the table. Keys are counted on the map side before they shuffle, and a foreign key meets its parent once for each distinct
value, so a hot key is one row by then.

Cases: a check that is null holds, as in SQL; keys with a null are not compared, unless the rule says what null is;
tables that are not given are not checked, and rules that refer to them are left out; an empty table breaks nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """``columns`` is "name type" with ``!`` behind a column that must not be null and ``(n)`` behind a string's type for
    its longest length. ``unique`` has keys as SQL expressions, each with the condition under which it holds."""

    columns: str
    primary: str
    unique: tuple[tuple[tuple[str, ...], str | None], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, str] = field(default_factory=dict)

    def parsed(self) -> list[tuple[str, str, int | None, bool]]:
        """(name, type, longest, required) of each column."""
        out = []
        for column in re.split(r",\s+", self.columns):
            name, kind = column.rstrip("!").split(" ", 1)
            size = re.fullmatch(r"string\((\d+)\)", kind)
            out.append((name, "string" if size else kind, int(size[1]) if size else None, column.endswith("!")))
        return out


# States and kinds that the rules allow.
RUN_STATES = ("pending", "running", "succeeded", "failed", "cancelled")
REVIEW_STATES = ("pending", "approved", "rejected", "needs_review")
ACTIVE_STATES = ("pending", "approved", "needs_review")
EVENT_TYPES = ("created", "status_changed", "approved", "rejected", "needs_review", "commented")
ROLES = ("user", "assistant", "system", "tool", "unknown")
EXTRACTIONS = ("extracted", "empty", "failed")
SEVERITIES = ("info", "warning", "error")


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


TABLES = {
    "workspaces": Table("workspace_id long!, name string(255)!, category string(255), active boolean!, source_created_at timestamp_ntz, source_updated_at timestamp_ntz, source_deleted_at timestamp_ntz, loaded_at timestamp!", "workspace_id"),
    "agents": Table(
        "agent_id string!, workspace_id long!, name string(255), model string(255)!, prompt string, start_message string(5000), model_vector_store_id string(255), active boolean!, source_created_at timestamp_ntz, source_updated_at timestamp_ntz, source_deleted_at timestamp_ntz, loaded_at timestamp!",
        "agent_id", foreign={"workspace_id": "workspaces"},
    ),
    "conversations": Table(
        "conversation_pk long!, source_agent_chat_id string!, conversation_id string(255), thread_id string(255), workspace_id long!, agent_id string, model string(255), phone_hash_or_obfuscated string(255), started_at timestamp_ntz, ended_at timestamp_ntz, raw_conversation string, raw_thread string, source_created_at timestamp_ntz, source_updated_at timestamp_ntz, agent_inference_method string(100)!, agent_inference_confidence decimal(4,3), agent_inference_notes string, loaded_at timestamp!",
        "conversation_pk", unique=((("source_agent_chat_id",), None),), checks={"confidence": "agent_inference_confidence BETWEEN 0 AND 1"}, foreign={"workspace_id": "workspaces", "agent_id": "agents"},
    ),
    "messages": Table(
        "message_pk long!, conversation_pk long!, source_chat_message_id string(255)!, role string(20)!, message_type string(255)!, content_text string, raw_message string!, raw_model_output string, created_at timestamp_ntz, updated_at timestamp_ntz, extraction_status string(20)!, extraction_notes string, loaded_at timestamp!",
        "message_pk", unique=((("source_chat_message_id",), None),), checks={"role": _in("role", ROLES), "extraction_status": _in("extraction_status", EXTRACTIONS)}, foreign={"conversation_pk": "conversations"},
    ),
    "existing_faqs": Table(
        "faq_id string!, source_agent_id string!, agent_id string, workspace_id long, question string!, answer string, image string(255), created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, is_active boolean!, loaded_at timestamp!",
        "faq_id", foreign={"agent_id": "agents", "workspace_id": "workspaces"},
    ),
    "pipeline_runs": Table(
        "run_id string!, workspace_id long, started_at timestamp!, finished_at timestamp, status string(30)!, parameters string!, notes string",
        "run_id", checks={"status": _in("status", RUN_STATES), "finished_after_started": "finished_at >= started_at"}, foreign={"workspace_id": "workspaces"},
    ),
    "pipeline_metrics": Table("metric_id long!, run_id string!, metric_name string(150)!, metric_value double, metric_metadata string!, created_at timestamp!", "metric_id", foreign={"run_id": "pipeline_runs"}),
    "question_clusters": Table(
        "cluster_id string!, run_id string, workspace_id long!, agent_id string, cluster_label string(255), algorithm string(100), representative_question string, centroid_embedding array<double>, cluster_size int!, cluster_metadata string!, created_at timestamp!",
        "cluster_id", checks={"size": "cluster_size >= 0"}, foreign={"run_id": "pipeline_runs", "workspace_id": "workspaces", "agent_id": "agents"},
    ),
    "faq_candidates": Table(
        "candidate_id string!, workspace_id long!, agent_id string, cluster_id string, normalized_question string!, suggested_answer string, cluster_label string(255), recurrence_count int!, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, status string(30)!, human_reviewed_by string(255), human_reviewed_at timestamp, created_at timestamp!, updated_at timestamp!, candidate_metadata string!, was_human_edited boolean!, last_edited_by string(255), last_edited_at timestamp",
        "candidate_id", unique=((("workspace_id", "coalesce(agent_id, '')", "lower(normalized_question)"), _in("status", ACTIVE_STATES)),),
        checks={"status": _in("status", REVIEW_STATES), "recurrence": "recurrence_count >= 0", "seen_window": "last_seen_at >= first_seen_at"}, foreign={"workspace_id": "workspaces", "agent_id": "agents", "cluster_id": "question_clusters"},
    ),
    "faq_candidate_examples": Table(
        "example_id long!, candidate_id string!, message_pk long!, conversation_pk long!, original_user_message string!, assistant_response string, similarity_score decimal(7,6), created_at timestamp!",
        "example_id", checks={"similarity": "similarity_score BETWEEN 0 AND 1"}, foreign={"candidate_id": "faq_candidates", "message_pk": "messages", "conversation_pk": "conversations"},
    ),
    "message_embeddings": Table(
        "message_embedding_id string!, message_pk long!, workspace_id long!, agent_id string, embedding_model string(255)!, embedding_dimension int!, embedding array<double>, embedding_metadata string!, created_at timestamp!",
        "message_embedding_id", unique=((("message_pk", "embedding_model"), None),), checks={"dimension": "embedding_dimension > 0", "array_dimension": "embedding IS NULL OR size(embedding) = embedding_dimension"},
        foreign={"message_pk": "messages", "workspace_id": "workspaces", "agent_id": "agents"},
    ),
    "faq_validation_events": Table(
        "validation_event_id string!, candidate_id string!, event_type string(40)!, previous_status string(30), new_status string(30)!, reviewer_identifier string(255), notes string, created_at timestamp!",
        "validation_event_id", checks={"type": _in("event_type", EVENT_TYPES), "status": _in("new_status", REVIEW_STATES), "previous_status": _in("previous_status", REVIEW_STATES)}, foreign={"candidate_id": "faq_candidates"},
    ),
    "data_quality_issues": Table(
        "issue_id string!, source_schema string(100)!, source_table string(100)!, source_pk string, faq_mvp_table string(100), faq_mvp_pk string, issue_type string(100)!, severity string(20)!, details string!, created_at timestamp!",
        "issue_id", unique=((("source_schema", "source_table", "coalesce(source_pk, '<null>')", "issue_type"), None),), checks={"severity": _in("severity", SEVERITIES)},
    ),
    "faq_candidate_edit_events": Table("edit_id string!, candidate_id string!, previous_question string, previous_answer string, new_question string!, new_answer string!, editor string(255), notes string, created_at timestamp!", "edit_id", foreign={"candidate_id": "faq_candidates"}),
}


def schema_of(name: str) -> StructType:
    """The Spark schema of a table, with what may be null."""
    return StructType.fromDDL(", ".join(f"{c} {kind}{' NOT NULL' * required}" for c, kind, _, required in TABLES[name].parsed()))


def _row_rules(df: DataFrame, name: str, rules: Table) -> DataFrame:
    broken = []
    for column, _, longest, required in rules.parsed():
        if column not in df.columns:
            continue
        if required:
            broken.append(F.when(F.col(column).isNull(), f"not_null: {column}"))
        if longest:
            broken.append(F.when(F.char_length(column) > longest, f"length: {column}"))
    broken += [F.when(~F.expr(check), f"check: {rule}") for rule, check in rules.checks.items()]
    found = df.select(F.col(rules.primary).cast("string").alias("key"), F.array_compact(F.array(*broken)).alias("rules")).filter(F.size("rules") > 0)
    return found.select(F.lit(name).alias("table_name"), F.explode("rules").alias("rule"), "key", F.lit(1).cast("long").alias("n"))


def _unique(df: DataFrame, name: str, keys: tuple[str, ...], where: str | None) -> DataFrame:
    rows = (df.filter(where) if where else df).select(*[F.expr(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)]).dropna()
    twice = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.select(F.lit(name).alias("table_name"), F.lit(f"unique: {', '.join(keys)}").alias("rule"), F.concat_ws("|", *rows.columns).alias("key"), "n")


def _orphans(df: DataFrame, name: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    lost = values.join(parent.select(F.col(key).alias("value")), "value", "left_anti")
    return lost.select(F.lit(name).alias("table_name"), F.lit(f"foreign: {column}").alias("rule"), F.col("value").cast("string").alias("key"), "n")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, key, n): each row that breaks a rule of its own, by primary key, and each key that is there more
    than once or has no parent, with the number of its rows. Columns that a table lacks are not looked at, but rules' are."""
    found = []
    for name, df in tables.items():
        rules = TABLES[name]
        found.append(_row_rules(df, name, rules))
        found += [_unique(df, name, keys, where) for keys, where in (((rules.primary,), None), *rules.unique)]
        found += [_orphans(df, name, column, tables[parent], TABLES[parent].primary) for column, parent in rules.foreign.items() if parent in tables and column in df.columns]
    return reduce(DataFrame.unionByName, found)


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a table: missing ones null, others left out."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind, _, _ in TABLES[name].parsed()])
