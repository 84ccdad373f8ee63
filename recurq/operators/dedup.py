"""Candidates against what is known: exact by normalised question, else by the nearest vector, per workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.functions import text as T
from recurq.functions.vectors import nearest

ACTIVE = ["pending", "approved", "needs_review"]


def known_faqs(faqs: DataFrame) -> DataFrame:
    return faqs.filter(F.col("is_active") & (F.trim(F.coalesce("question", F.lit(""))) != ""))


def known_candidates(candidates: DataFrame, skip_rejected: bool = True) -> DataFrame:
    return candidates.filter(F.col("status").isin([*ACTIVE, "rejected"] if skip_rejected else ACTIVE))


def mark_known(new: DataFrame, known: DataFrame, key: str, question: str, vector: str, within: str, threshold: float = 0.78) -> DataFrame:
    """``new`` with ``exact_match`` and ``semantic_match`` against ``known`` (same column names)."""
    exact = known.select(F.col(within).alias("__w"), T.normalize_question(question).alias("__q")).distinct().withColumn("__hit", F.lit(True))
    marked = new.withColumn("__n", T.normalize_question(question)).join(exact, (F.col(within) == F.col("__w")) & (F.col("__n") == F.col("__q")), "left")
    marked = marked.withColumn("exact_match", F.coalesce("__hit", F.lit(False))).drop("__w", "__q", "__hit", "__n")
    best = nearest(new, known, key, vector, within)
    return marked.join(best, key, "left").withColumn("semantic_match", F.coalesce(F.col("best") >= threshold, F.lit(False)))


def against_faqs(new: DataFrame, faqs: DataFrame, **names) -> DataFrame:
    """Candidates that no FAQ covers."""
    return mark_known(new, faqs, **names).filter("NOT exact_match AND NOT semantic_match").drop("exact_match", "semantic_match", "best")


def against_candidates(new: DataFrame, earlier: DataFrame, **names) -> DataFrame:
    """Exact matches stay and supersede; others that are near an earlier candidate go."""
    return mark_known(new, earlier, **names).filter("exact_match OR NOT semantic_match").withColumnRenamed("exact_match", "superseded_previous_candidate").drop("semantic_match", "best")


def merge_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates after a run, keyed by workspace, agent and lower-case question: the newest that is open is updated, its
    status going from pending to needs_review only; others are added."""
    keyed = lambda df: df.withColumn("__a", F.coalesce("agent_id", F.lit(""))).withColumn("__q", F.lower("normalized_question"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("workspace_id", "__a", "__q").orderBy(F.desc("created_at"), "candidate_id")
    newest = keyed(old).filter(F.col("status").isin(ACTIVE)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("workspace_id", "__a", "__q", F.col("candidate_id").alias("__old"), F.col("status").alias("__status"), F.col("created_at").alias("__created"))
    joined = keyed(new).join(newest, ["workspace_id", "__a", "__q"], "left")
    status = F.when(F.col("__status").isNull(), F.col("status")).when((F.col("__status") == "pending") & (F.col("status") == "needs_review"), "needs_review").otherwise(F.col("__status"))
    updated = joined.withColumn("candidate_id", F.coalesce("__old", "candidate_id")).withColumn("created_at", F.coalesce("__created", "created_at")).withColumn("status", status).select(new.columns)
    return old.join(updated.select("candidate_id"), "candidate_id", "left_anti").unionByName(updated, allowMissingColumns=True)
