"""What a run leaves behind: clusters, candidates, examples, created events, embeddings and metrics, committed as one version.

Clusters, examples, events, embeddings and metrics are appended only. A candidate names the cluster of its last run, so the
examples of that cluster replace those of earlier runs without rewriting them (``current_examples``).

Cases: candidates without a workspace are left out; of candidates of one run that share workspace, agent and question, the
last cluster's stays, for review if one of them is; examples without a message or conversation are left out; a run that is
put in twice adds a version in which its clusters are once.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.functions.vectors import as_double, dot
from recurq.operators import embeddings
from recurq.operators.cluster import centroids
from recurq.operators.review import top_examples
from recurq.plans import pipeline
from recurq.sources.shared import written
from recurq.sources.store import State, Store

#: Reasons of the gates on clusters, before generation.
GATES = ["cluster_too_small", "two_example_cohesion", "low_support", "low_cohesion", "mixed_intent", "question_evidence", "answer_evidence"]
REPEATS = ["duplicate_of_faq", "duplicate_of_candidate"]


def clusters_of(run: pipeline.Run, run_id: str) -> DataFrame:
    """A row a cluster with the id that the run's candidates have and the id it is stored by."""
    made = F.md5(F.concat_ws("|", "workspace_id", "label", "representative"))
    return run.clusters.select(
        made.alias("candidate_id"), F.md5(F.concat_ws("|", F.lit(run_id), "workspace_id", "label")).alias("cluster_id"), F.lit(run_id).alias("run_id"), "workspace_id", "agent_id", "label",
        "algorithm", F.col("representative").alias("representative_question"), F.col("centroid").alias("centroid_embedding"), F.col("size").cast("long").alias("cluster_size"),
    )


def one_a_question(candidates: DataFrame) -> DataFrame:
    """Of candidates with one workspace, agent and question, that of the last label, for review if any is."""
    keys = [F.col("workspace_id"), F.coalesce("agent_id", F.lit("")), F.lower("normalized_question")]
    rows = F.struct("label", "candidate_id")
    last = candidates.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(rows).alias("__last"), F.max(F.col("status") == "needs_review").alias("__review"))
    last = last.select(F.col("__last.candidate_id").alias("candidate_id"), "__review")
    return candidates.join(last, "candidate_id").withColumn("status", F.when(F.col("__review"), "needs_review").otherwise(F.col("status"))).drop("__review")


def examples_of(members: DataFrame, kept: DataFrame, most: int = 10) -> DataFrame:
    """The members nearest to the centroid of each kept cluster, each with its message, its reply and its similarity."""
    keys = ["workspace_id", "label"]
    mine = members.join(kept.select(*keys, "cluster_id", "candidate_id"), keys).filter("message_pk IS NOT NULL AND conversation_pk IS NOT NULL")
    near = mine.join(centroids(members, keys, "embedding"), keys).withColumn("similarity_score", dot(as_double("embedding"), F.col("centroid")))
    return top_examples(near, ["cluster_id"], "similarity_score", "message_pk", most).select(
        "candidate_id", "cluster_id", "message_pk", "conversation_pk", F.col("user_text").alias("original_user_message"), F.col("assistant_text").alias("assistant_response"), "similarity_score",
        F.col("rank").cast("int").alias("rank"), "clean", "workspace_id", "embedding",
    )


def base_metrics(run: pipeline.Run, n_embeddings: int, since_days: int | None) -> DataFrame:
    """The twelve figures of a run, one row."""
    kept, reason = F.col("reject_reason").isNull(), F.col("reject_reason")
    gated, aligned = reason.isin(*GATES), reason != "question_misaligned"
    n = run.candidates.agg(
        F.coalesce(F.sum(F.when(kept, F.col("recurrence_count"))), F.lit(0)).cast("long").alias("faq_candidate_messages"), F.count_if(kept).alias("candidates_generated"),
        F.count_if(kept | ~gated).alias("clusters_valid"), F.count_if(gated).alias("clusters_rejected"), F.count_if(~gated & aligned & ~reason.isin(*REPEATS)).alias("llm_rejected"),
        F.count_if(~aligned).alias("validator_rejected"), F.count_if(reason.isin(*REPEATS)).alias("duplicates_omitted"), F.count_distinct(F.when(kept, F.col("workspace_id"))).alias("workspaces_processed"),
    )
    n = n.withColumn("average_cluster_size", F.when(F.col("candidates_generated") > 0, F.round(F.col("faq_candidate_messages") / F.col("candidates_generated"), 2)).otherwise(0.0))
    talks = run.pairs.agg(F.count_distinct("conversation_pk").alias("conversations_analyzed"))  # two one-row frames
    return talks.crossJoin(n).withColumn("embeddings_persisted", F.lit(n_embeddings)).withColumn("since_days", F.lit(since_days).cast("long"))


def metric_rows(run: pipeline.Run, run_id: str, n_embeddings: int, since_days: int | None, about: dict) -> DataFrame:
    """(run_id, metric_name, metric_value, metric_metadata): the twelve and one a stage and reason. A value that is unknown is null."""
    one = base_metrics(run, n_embeddings, since_days)
    base = one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric_name", "metric_value")
    stages = run.metrics.select(F.concat_ws(".", "stage", "reason").alias("metric_name"), F.col("n").cast("double").alias("metric_value"))
    return base.unionByName(stages).select(F.lit(run_id).alias("run_id"), "metric_name", "metric_value", F.lit(json.dumps(about, sort_keys=True)).alias("metric_metadata"))


def persist(store: Store, run: pipeline.Run, run_id: str, at: datetime.datetime, model: str = "hash", since_days: int | None = None) -> State:
    """Commit a run on the newest version; nothing of it shows if this fails."""
    since = store.state()
    known, held = store.read("clusters", since), store.read("candidates", since)
    if known is not None and not known.filter(F.col("run_id") == run_id).isEmpty():
        return since
    of_cluster = clusters_of(run, run_id)
    made = run.candidates.filter("reject_reason IS NULL AND workspace_id IS NOT NULL").join(of_cluster.select("candidate_id", "cluster_id", "label"), "candidate_id")
    made = one_a_question(written(made, "made")).drop("label")
    table = written(pipeline.persisted(held, made, at), "candidates")
    kept = written(of_cluster.drop("candidate_id").join(table.select("cluster_id", "candidate_id"), "cluster_id"), "kept")
    examples = written(examples_of(run.members, kept), "examples")
    # vectors of the examples only, as the run has them
    new = embeddings.delta(examples.select("message_pk", "clean", "workspace_id", "embedding"), store.read("embeddings", since), "clean", model, F.col("embedding"), ["workspace_id"])
    created = table.filter(F.col("created_at") == F.lit(at)).join(kept.select("cluster_id"), "cluster_id", "left_semi")
    events = created.select(
        "candidate_id", F.lit("created").alias("event_type"), F.lit(None).cast("string").alias("previous_status"), F.col("status").alias("new_status"), F.lit("pipeline").alias("reviewer"), F.lit(at).alias("at"),
        F.lit(f"run {run_id}").alias("notes"),
    )
    about = {"embedding_model": model, "since_days": since_days}
    metrics = metric_rows(run, run_id, new.count(), since_days, about)
    return store.commit(
        since,
        replace={"candidates": table},
        append={"clusters": kept.drop("label"), "examples": examples.drop("clean", "workspace_id", "embedding"), "events": events, "embeddings": new, "metrics": metrics},
    )


def current_examples(store: Store, state: State | None = None) -> DataFrame:
    """The examples of each candidate's last cluster."""
    state = state or store.state()
    return store.read("examples", state).join(store.read("candidates", state).select("candidate_id", "cluster_id"), ["candidate_id", "cluster_id"], "left_semi")


def table_counts(store: Store, state: State | None = None) -> DataFrame:
    """(table_name, n) of every table of a version."""
    state = state or store.state()
    counts = [store.read(name, state).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in sorted(state.tables)]
    found = store.spark.createDataFrame([], "table_name string, n long")
    for c in counts:
        found = found.unionByName(c)
    return found
