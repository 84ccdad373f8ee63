"""Review: an append-only log of edits and decisions; the state of a candidate is what the log says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.functions import lexicon as L

STATUSES = ["pending", "needs_review", "approved", "rejected"]


def require_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return status


def edit_events(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """One event for each request (candidate_id, question, answer, editor, at) that changes something.

    A request with a blank question or answer has ``error`` and changes nothing.
    """
    j = requests.join(candidates.select("candidate_id", F.col("normalized_question").alias("previous_question"), F.col("suggested_answer").alias("previous_answer")), "candidate_id")
    blank = (F.trim("question") == "") | (F.trim("answer") == "")
    new_q, new_a = F.coalesce(F.trim("question"), "previous_question"), F.coalesce(F.trim("answer"), "previous_answer")
    events = j.select("candidate_id", "previous_question", "previous_answer", new_q.alias("new_question"), new_a.alias("new_answer"), "editor", "at", F.when(blank, "blank").alias("error"))
    changed = ~F.col("previous_question").eqNullSafe(F.col("new_question")) | ~F.col("previous_answer").eqNullSafe(F.col("new_answer"))
    return events.filter(changed | F.col("error").isNotNull())


def decisions(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Validation events of requests (candidate_id, status, reviewer, at) with the status before, and promotion errors.

    Approval promotes, for which an agent and an answer are needed.
    """
    j = requests.withColumnRenamed("status", "new_status").join(candidates.select("candidate_id", F.col("status").alias("previous_status"), "agent_id", "suggested_answer"), "candidate_id")
    lacks = F.col("agent_id").isNull() | (F.trim(F.coalesce("suggested_answer", F.lit(""))) == "")
    error = F.when(~F.col("new_status").isin(STATUSES), "unknown_status").when((F.col("new_status") == "approved") & lacks, "cannot_promote")
    kind = F.when(F.col("new_status") == "needs_review", "marked_needs_review").otherwise(F.col("new_status"))
    return j.select("candidate_id", kind.alias("event_type"), "previous_status", "new_status", "reviewer", "at", error.alias("error"))


def state(candidates: DataFrame, edits: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates after their events: text of the last edit, status of the last decision, and counts."""
    # the last event as a whole, so that a tie of times can't mix two
    last = edits.filter("error IS NULL").groupBy("candidate_id").agg(F.max(F.struct("at", "new_question", "new_answer", "editor")).alias("__e"), F.count(F.lit(1)).alias("__n"))
    e = last.select("candidate_id", F.col("__e.new_question").alias("__q"), F.col("__e.new_answer").alias("__a"), "__n", F.col("__e.editor").alias("last_edited_by"), F.col("__e.at").alias("last_edited_at"))
    decided = events.filter("error IS NULL").groupBy("candidate_id").agg(F.max(F.struct("at", "new_status", "reviewer")).alias("__v"))
    v = decided.select("candidate_id", F.col("__v.new_status").alias("__s"), F.col("__v.reviewer").alias("human_reviewed_by"))
    j = candidates.drop("last_edited_by", "last_edited_at", "human_reviewed_by").join(e, "candidate_id", "left").join(v, "candidate_id", "left")
    return (
        j.withColumn("normalized_question", F.coalesce("__q", "normalized_question"))
        .withColumn("suggested_answer", F.coalesce("__a", "suggested_answer"))
        .withColumn("status", F.coalesce("__s", "status"))
        .withColumn("edit_count", F.coalesce("__n", F.lit(0)))
        .withColumn("was_human_edited", F.col("edit_count") > 0)
        .drop("__q", "__a", "__s", "__n")
    )


def promoted(candidates: DataFrame) -> DataFrame:
    """FAQs of approved candidates, keyed by the candidate; they enter the next run's known FAQs by an upsert."""
    return candidates.filter("status = 'approved' AND agent_id IS NOT NULL AND trim(suggested_answer) <> ''").select(
        F.col("candidate_id").alias("faq_id"), F.col("agent_id").alias("source_agent_id"), "agent_id", "workspace_id", F.col("normalized_question").alias("question"), F.col("suggested_answer").alias("answer"), F.lit(True).alias("is_active")
    )


def latest_run(runs: DataFrame, workspace_id: int | None = None) -> DataFrame:
    """The latest run that succeeded; with a workspace, runs over all workspaces count, too."""
    found = runs.filter("status = 'succeeded'")
    if workspace_id is not None:
        found = found.filter((F.col("workspace_id") == workspace_id) | F.col("workspace_id").isNull())
    return found.orderBy(F.desc_nulls_last("finished_at"), F.desc("started_at"), "run_id").limit(1)


def list_suggestions(candidates: DataFrame, clusters: DataFrame, workspaces: DataFrame, examples: DataFrame, runs: DataFrame, metrics: DataFrame, edits: DataFrame, status: str | None = None, workspace_id: int | None = None, include_all: bool = False) -> DataFrame:
    """Candidates with their company, run, silhouette, edits and examples by similarity. Sides are aggregated before joins."""
    found = candidates
    if status is not None:
        found = found.filter(F.col("status") == require_status(status))
    if workspace_id is not None:
        found = found.filter(F.col("workspace_id") == workspace_id)
    of_run = clusters.select("cluster_id", "run_id")
    if not include_all:
        of_run = of_run.join(F.broadcast(latest_run(runs, workspace_id).select("run_id")), "run_id", "left_semi")
    texts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity_score")).alias("s"), F.col("original_user_message").alias("m")))), lambda x: x["m"])
    ex = examples.filter("original_user_message IS NOT NULL").groupBy("candidate_id").agg(texts.alias("support_examples"))
    ed = edits.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("edit_count"))
    silhouettes = metrics.filter("metric_name = 'silhouette_score'").groupBy("run_id").agg(F.max("metric_value").alias("silhouette_score"))
    j = found.join(workspaces.select("workspace_id", F.col("name").alias("company_name")), "workspace_id").join(of_run, "cluster_id", "left" if include_all else "inner")
    j = j.join(silhouettes, "run_id", "left").join(ex, "candidate_id", "left").join(ed, "candidate_id", "left")
    return j.withColumn("edit_count", F.coalesce("edit_count", F.lit(0))).withColumn("support_examples", F.coalesce("support_examples", F.array().cast("array<string>")))


def review_label(code: Column, reason: Column) -> Column:
    """What a reviewer reads of a review reason: by its code, else by what the reason has, else the reason; null without one."""
    by_code = F.element_at(F.create_map(*[F.lit(x) for pair in L.REVIEW_LABELS.items() for x in pair]), code)
    label = F.nullif(reason, F.lit(""))
    for part, text in reversed(L.REVIEW_LABEL_PARTS):
        label = F.when(F.lower(reason).contains(part), text).otherwise(label)
    return F.coalesce(by_code, label)


def suggestion_summary(suggestions: DataFrame, company: str = "workspace_id", size: str = "recurrence_count", silhouette: str = "silhouette_score") -> DataFrame:
    """One row over listed suggestions: companies, clusters, examples, examples a cluster, and a silhouette, that of the least candidate id that has one."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))
    return suggestions.agg(
        F.count_distinct(company).alias("company_count"), n.alias("cluster_count"), total.cast("long").alias("total_examples"),
        F.when(n > 0, F.round(total / n, 2)).otherwise(0.0).alias("average_cluster_size"), F.round(F.min_by(silhouette, F.when(F.col(silhouette).isNotNull(), F.col("candidate_id"))), 4).alias("silhouette_score"),
    )


def list_events(events: DataFrame, candidates: DataFrame, workspace_id: int | None = None) -> DataFrame:
    found = events.filter("event_type <> 'created'").join(candidates.select("candidate_id", "workspace_id", F.left("normalized_question", F.lit(180)).alias("question_preview")), "candidate_id", "left")
    return found if workspace_id is None else found.filter(F.col("workspace_id") == workspace_id)


def list_workspaces(workspaces: DataFrame, conversations: DataFrame) -> DataFrame:
    return workspaces.join(conversations.select("workspace_id"), "workspace_id", "left_semi").select("workspace_id", "name").orderBy("name", "workspace_id")


def search(suggestions: DataFrame, words: str = "", status: str | None = None) -> DataFrame:
    """Suggestions whose question or answer has ``words``, in any case."""
    hay = F.lower(F.concat_ws(" ", "normalized_question", "suggested_answer"))
    found = suggestions.filter(hay.contains(words.strip().lower()))
    return found if status is None else found.filter(F.col("status") == status)


def top_examples(members: DataFrame, cluster: list[str], similarity: str, position: str, most: int = 10) -> DataFrame:
    w = Window.partitionBy(*cluster).orderBy(F.desc(similarity), position)
    return members.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
