"""The analytic run: eligible messages to candidates, as one plan with every gate a column."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.config import Settings
from recurq.functions import text as T
from recurq.functions.vectors import as_double, dot, hash_embedding
from recurq.operators import cluster as C
from recurq.operators import dedup, generate, pairing
from recurq.operators import quality as Q
from recurq.operators.cluster_scale import cluster_workspaces
from recurq.operators.examples import most_frequent
from recurq.sources.shared import written


@dataclass
class Run:
    """What a run makes: pairs with their reject reasons, cluster members, all clusters with reasons, and candidates."""

    pairs: DataFrame
    members: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    metrics: DataFrame


def questions(messages: DataFrame, s: Settings, as_of: datetime.datetime | None = None) -> DataFrame:
    """Pairs of eligible, truncated messages with the cleaned question and why it is no candidate."""
    kept = pairing.truncated(pairing.eligible(messages, as_of, s.look_back_days if as_of else None), "conversation_pk", "created_at", s.message_limit)
    found = pairing.pairs(kept, "conversation_pk", ["created_at", "message_pk"])
    clean = T.normalize_chat_text("user_text", s.strip_urls, s.strip_emojis)
    return written(found.withColumn("clean", clean), "cleaned").withColumn("reject_reason", T.candidate_reject_reason(F.col("clean")))


def cluster_rows(members: DataFrame, s: Settings) -> DataFrame:
    """One row a cluster: sizes, support, cohesion, representative, questions, answers, gate and review reasons."""
    keys = ["workspace_id", "label"]
    stats = C.support_and_cohesion(members, keys, "embedding")
    near = members.join(C.centroids(members, keys, "embedding"), keys).withColumn("similarity", dot(as_double("embedding"), F.col("centroid")))
    rank = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "message_pk")
    near = near.withColumn("rank", F.row_number().over(rank))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("message_pk", c))), lambda x: x[c])
    texts = near.groupBy(*keys).agg(
        F.min_by("clean", "rank").alias("representative"), ordered("clean").alias("questions"), ordered("assistant_text").alias("raw_answers"), F.first("algorithm").alias("algorithm"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.any_value("centroid").alias("centroid"), F.avg("similarity").alias("average_similarity"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "user_text", "similarity")))), lambda x: F.struct(x["user_text"].alias("text"), x["similarity"].alias("similarity"))).alias("examples"),
    )
    # the agent most pairs of a cluster have, the first seen on a tie
    agents = most_frequent(members, keys, "agent_id", "message_pk").drop("n") if "agent_id" in members.columns else members.select(*keys, F.lit(None).cast("string").alias("agent_id")).distinct()
    out = stats.join(texts, keys).join(agents, keys, "left")
    out = written(out.withColumn("clean_answers", F.transform("raw_answers", lambda a: T.clean_answer_evidence(a))), "answers")
    answers = F.filter("clean_answers", T.is_answer_evidence_usable)
    distinct = F.array_distinct(F.filter(F.transform("questions", lambda q: T.normalize_question(T.clean_question_evidence(q))), lambda q: q != ""))
    out = written(out.withColumn("answers", answers).withColumn("n_questions", F.size(distinct)).withColumn("categories", Q.intents_of(F.col("questions"))), "evidence")
    mixed = Q.is_mixed(F.col("categories"))
    args = (F.col("size"), F.col("support"), F.col("cohesion"), mixed, s)
    few_questions = ~((F.col("n_questions") >= s.min_question_evidence) | ((F.col("n_questions") == 1) & (F.col("size") >= 3)))
    no_answers = (F.size("answers") == 0) & (F.size("categories") == 0)
    gate = F.coalesce(Q.gate(*args), F.when(few_questions, "question_evidence"), F.when(no_answers, "answer_evidence"))
    reviews = F.concat(Q.gate_reviews(*args), F.array_compact(F.array(F.when(F.col("n_questions") == 1, "single_question_form"), F.when(F.size("answers") == 0, "no_usable_answer"))))
    return out.withColumn("gate_reject", gate).withColumn("review_reasons", reviews)


def messages_of(msgs: DataFrame, convs: DataFrame | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """Messages of conversations in known workspaces, with the agent of the conversation; without conversations, messages as they are."""
    if convs is None or workspaces is None:
        return msgs.select("conversation_pk", "message_pk", "workspace_id", "role", "content_text", "created_at")
    of = convs.select("conversation_pk", "workspace_id", "agent_id").join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    return msgs.select("conversation_pk", "message_pk", "role", "content_text", "created_at").join(of, "conversation_pk")


def candidates_of(clusters: DataFrame, known: DataFrame, s: Settings, earlier: DataFrame | None = None) -> DataFrame:
    """All clusters through generation, evidence, validation, alignment, known FAQs and ``earlier`` candidates.

    ``reject_reason`` says where one ended. A candidate whose question an earlier one has exactly stays and
    supersedes it; one that is only near an earlier one goes.
    """
    staged = generate.recovered(generate.with_template(clusters), s)
    staged = staged.withColumn("candidate_id", F.md5(F.concat_ws("|", "workspace_id", "label", "representative")))
    embed = hash_embedding(s.embedding_dim)
    staged = written(staged.withColumn("question_vector", embed(T.fold_text(F.col("generation.canonical_question")))), "staged")
    fit = Q.alignment(F.col("generation.canonical_question"), F.col("questions"), dot(F.col("question_vector"), F.col("centroid")), F.col("average_similarity"), s)
    staged = written(staged.withColumn("alignment", fit), "aligned")
    named = staged.withColumn("question", F.col("generation.canonical_question"))
    faqs = written(known.select("workspace_id", "question", embed(T.fold_text("question")).alias("question_vector")), "known")
    marked = dedup.mark_known(named, faqs, "candidate_id", "question", "question_vector", "workspace_id", s.duplicate_threshold)
    if earlier is None:
        marked = marked.withColumn("same_candidate", F.lit(False)).withColumn("near_candidate", F.lit(False))
    else:
        held = dedup.known_candidates(earlier, s.skip_rejected).select("workspace_id", F.col("normalized_question").alias("question"), embed(T.fold_text("normalized_question")).alias("question_vector"))
        held = dedup.mark_known(named, written(held, "earlier"), "candidate_id", "question", "question_vector", "workspace_id", s.duplicate_threshold)
        marked = marked.join(held.select("candidate_id", F.col("exact_match").alias("same_candidate"), (F.col("semantic_match") & ~F.col("exact_match")).alias("near_candidate")), "candidate_id")
    reason = F.coalesce(
        F.col("gate_reject"), F.col("generation_reject"), F.when(F.col("alignment.status") == "misaligned", "question_misaligned"), F.when(F.col("exact_match") | F.col("semantic_match"), "duplicate_of_faq"),
        F.when(F.col("near_candidate"), "duplicate_of_candidate"),
    )
    g = F.col("generation")
    earlier = F.concat("review_reasons", F.array_compact(F.array(F.when(F.col("evidence.answer_review"), F.col("evidence.reason")), F.when(F.col("alignment.status") == "partial_alignment", "partial_alignment"))))
    reasons = Q.tier_reasons(g["confidence"], F.col("cohesion"), F.col("support"), F.size("answers"), earlier, s)
    return marked.select(
        "candidate_id", "workspace_id", "agent_id", F.left("representative", F.lit(120)).alias("cluster_label"), g["canonical_question"].alias("normalized_question"), g["canonical_answer"].alias("suggested_answer"),
        F.col("size").cast("int").alias("recurrence_count"), "first_seen_at", "last_seen_at", "candidate_kind", "algorithm", "support", "cohesion", "alignment", "evidence", "examples",
        Q.score(F.col("size"), F.col("cohesion"), g["confidence"], F.size("questions"), F.size("answers")).alias("cluster_score"),
        Q.tier(reasons).alias("quality_tier"), F.array_join(reasons, "; ").alias("review_reason"), F.when(F.size(reasons) > 0, "needs_review").otherwise("pending").alias("status"), reason.alias("reject_reason"),
        F.col("same_candidate").alias("superseded_previous_candidate"),
    )


def metrics_of(pairs: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """(stage, reason, n): how many rows each rule of each stage stopped, and how many passed."""
    count = lambda df, stage, column: df.groupBy(F.lit(stage).alias("stage"), F.coalesce(column, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    clustered = F.when(members["label"] < 0, "noise")
    return count(pairs, "question", pairs["reject_reason"]).unionByName(count(members, "cluster_member", clustered)).unionByName(count(candidates, "cluster", candidates["reject_reason"]))


def persisted(old: DataFrame | None, candidates: DataFrame, at: datetime.datetime) -> DataFrame:
    """The table of candidates after a run: those the run made are put in by workspace, agent and question."""
    # ids are of this run: a cluster that comes again after its candidate was rejected is another candidate
    made = candidates.filter("reject_reason IS NULL").drop("reject_reason").withColumn("created_at", F.lit(at)).withColumn("candidate_id", F.md5(F.concat_ws("|", "candidate_id", "created_at")))
    return made if old is None else dedup.merge_candidates(old, made)


def run(messages: DataFrame, known: DataFrame, s: Settings = Settings(), as_of: datetime.datetime | None = None, earlier: DataFrame | None = None) -> Run:  # noqa: B008
    """The whole analysis. ``messages`` has conversation_pk, message_pk, workspace_id, role, content_text, created_at, and
    ``agent_id`` where it is known; ``earlier``, the table of candidates before the run, has workspace_id, normalized_question, status."""
    pairs = written(questions(messages, s, as_of), "pairs")
    good = pairs.filter("reject_reason IS NULL")
    vectors = written(good.withColumn("embedding", hash_embedding(s.embedding_dim)(T.fold_text("clean"))), "vectors")
    labels = cluster_workspaces(vectors, "workspace_id", "message_pk", "embedding", s)
    members = written(vectors.join(labels, "message_pk"), "members")
    clusters = written(cluster_rows(members.filter("label >= 0"), s), "clusters")
    candidates = written(candidates_of(clusters, known, s, earlier), "candidates")
    return Run(pairs, members, clusters, candidates, metrics_of(pairs, members, candidates))
