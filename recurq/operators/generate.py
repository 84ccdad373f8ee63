"""Canonical questions and answers: parsing of a model's output, prudent templates, and the repair stages.

A generator is any function from a batch of prompts to texts; without one the template generator is used, which
is deterministic. Stages are columns over one row a cluster, never a loop over clusters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.functions import lexicon as L
from recurq.functions import text as T
from recurq.operators import quality as Q
from recurq.sources.shared import written

GENERATION = "publish boolean, cluster_intent_statement string, knowledge_statement string, canonical_question string, canonical_answer string, confidence double, reason string"
_REQUIRED = {"publish": bool, "canonical_question": str, "canonical_answer": str, "confidence": (int, float), "reason": str}


def parse_generation(raw: str | None) -> dict | None:
    """A model's text as a generation, or null: thinking is dropped, the object may stand in prose, each required field
    has its type, and confidence is from 0 to 1. A published candidate with confidence 0 and a reason that calls the
    intent clear gets 0.45, marked repaired."""
    text = (raw or "").split("</think>")[-1].strip()
    found = None
    for piece in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            found = json.loads(piece)
            break
        except ValueError:
            continue
    if not isinstance(found, dict) or any(not isinstance(found.get(k), kind) or (kind is not bool and isinstance(found.get(k), bool)) for k, kind in _REQUIRED.items()):
        return None
    if not 0 <= found["confidence"] <= 1:
        return None
    out = {k: found.get(k) for k in ("publish", "cluster_intent_statement", "knowledge_statement", "canonical_question", "canonical_answer", "confidence", "reason")}
    out["confidence"] = float(out["confidence"])
    folded = out["reason"].lower()
    out["repaired"] = bool(out["publish"] and out["confidence"] == 0 and ("clara" in folded or "clear" in folded))
    if out["repaired"]:
        out["confidence"] = 0.45
    return out


def parsed(raw: Column) -> Column:
    """``parse_generation`` over Arrow batches, as a struct."""

    @F.pandas_udf(f"{GENERATION}, repaired boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_generation(t) or {} for t in texts]
        names = [c.split()[0] for c in f"{GENERATION}, repaired boolean".split(", ")]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return run(raw)


def generate(clusters: DataFrame, prompt: Column, model: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """``clusters`` with ``raw``, the model's text for ``prompt``; the model is called on executors, a batch at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clusters.schema.fields) + ", raw string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            prompts = part.pop("__prompt").tolist()
            yield part.assign(raw=[t for k in range(0, len(prompts), batch) for t in model(prompts[k : k + batch])])

    return clusters.withColumn("__prompt", prompt).mapInPandas(run, schema)


def focus_tokens(questions: Column, most: int = 4) -> Column:
    """The most frequent support tokens of an array of questions, the first seen first on a tie."""
    every = F.transform(F.flatten(F.transform(questions, T.support_tokens)), lambda t, i: F.struct(t.alias("token"), i.alias("at")))

    def ranked(tokens: Column) -> Column:
        # sorted by token and place, so equal tokens are a run that begins with the first one seen
        begins = F.filter(F.transform(tokens, lambda x, i: F.when((i == 0) | (F.get(tokens, i - 1)["token"] != x["token"]), i)), lambda i: i.isNotNull())
        return T.let(begins, lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(tokens))).alias("n"), F.get(tokens, i)["at"].alias("at"), F.get(tokens, i)["token"].alias("token"))))

    return F.transform(F.slice(F.array_sort(T.let(F.array_sort(every), ranked)), 1, most), lambda r: r["token"])


def _sentence(rules: list, categories: Column, folded: Column, focus: Column) -> Column:
    found = F.lit(None).cast("string")
    for category, terms, sentence in reversed(rules):
        holds = F.lit(True) if category is None else F.array_contains(categories, category)
        holds = reduce(lambda a, b: a & b, [T.has_any(folded, t) for t in terms], holds)
        value = F.lit(sentence)
        if "{}" in sentence:
            holds, value = holds & (focus != ""), F.replace(F.lit(sentence), F.lit("{}"), focus)
        found = F.when(holds, value).otherwise(found)
    return found


def _product_focus(questions: Column) -> Column:
    kept = F.array_except(focus_tokens(questions), F.array(*[F.lit(w) for w in L.FOCUS_STOP]))
    return F.array_join(F.slice(kept, 1, 3), " ")


def _prudent(rules: list, questions: Column, categories: Column) -> Column:
    folded = T.fold_text(F.array_join(questions, " "))
    return T.let(folded, lambda f: T.let(_product_focus(questions), lambda focus: _sentence(rules, categories, f, focus)))


def prudent_answer(questions: Column, categories: Column) -> Column:
    """A cautious sentence for the first intent in order of payment, scheduling, shipping, product and price."""
    return _prudent(L.PRUDENT_ANSWERS, questions, categories)


def prudent_question(questions: Column, categories: Column) -> Column:
    """A cautious question for the first intent in order of shipping, payment, scheduling, price and product."""
    return _prudent(L.PRUDENT_QUESTIONS, questions, categories)


def intent_statement(questions: Column) -> Column:
    return T.let(F.filter(F.transform(questions, T.clean_question_evidence), lambda x: x != ""), _statement)


def _statement(qs: Column) -> Column:
    """``intent_statement`` from cleaned questions."""
    about = F.arrays_overlap(F.flatten(F.transform(qs, T.support_tokens)), F.array(*[F.lit(t) for t in L.SHIPPING_FOCUS]))
    parts = F.struct(Q.intents_of(qs).alias("categories"), about.alias("about"), F.array_join(focus_tokens(qs), " ").alias("focus"))
    s = L.INTENT_STATEMENTS

    def stated(p: Column) -> Column:
        known = lambda c: F.array_contains(p["categories"], c)
        with_focus = lambda name: F.replace(F.lit(s[name]), F.lit("{}"), p["focus"])
        return Q.first_of(
            [
                (known("shipping") & (p["about"] | ~known("product_availability")), s["shipping"]),
                (known("payment"), s["payment"]),
                (known("scheduling"), s["scheduling"]),
                (known("product_availability") & (p["focus"] != ""), with_focus("product_focus")),
                (known("product_availability"), s["product_availability"]),
                (known("pricing"), s["pricing"]),
                (p["focus"] != "", with_focus("focus")),
            ],
            F.lit(s["other"]),
        )

    return T.let(parts, stated)


def with_template(clusters: DataFrame) -> DataFrame:
    """``clusters`` (questions, answers, representative) with ``generation`` of the deterministic generator: the cleaned
    representative as question, the first usable answer or a prudent one; and ``categories``, ``prudent_answer``,
    ``prudent_question``. Rows are few, one a cluster, so each step is a small table that the next one reads."""
    q = F.col("questions")
    rows = written(
        clusters.withColumn("categories", Q.intents_of(q)).withColumn("clean_answers", F.transform("answers", lambda a: T.clean_canonical_answer(a)))
        .withColumn("own_question", T.clean_canonical_question("representative")).withColumn("intent_statement", intent_statement(q)), "cleaned",
    )
    rows = written(
        rows.withColumn("usable", F.filter("clean_answers", lambda a: Q.is_valid_answer(a))).withColumn("own_valid", Q.is_valid_question(F.col("own_question")))
        .withColumn("prudent_answer", prudent_answer(q, F.col("categories"))).withColumn("prudent_question", prudent_question(q, F.col("categories"))), "prudent",
    )
    answer = F.coalesce(F.get("usable", F.lit(0)), "prudent_answer")
    question = F.when(F.col("own_valid"), F.col("own_question")).otherwise(F.coalesce("prudent_question", "own_question"))
    generation = F.struct(
        (F.size(q) >= 2).alias("publish"), F.col("intent_statement").alias("cluster_intent_statement"), answer.alias("knowledge_statement"), question.alias("canonical_question"),
        answer.alias("canonical_answer"), F.when(F.size("usable") > 0, 0.75).otherwise(0.55).alias("confidence"), F.lit("template").alias("reason"),
    )
    return written(rows.withColumn("generation", generation).drop("clean_answers", "own_question", "own_valid", "usable", "intent_statement"), "generated")


def recovered(clusters: DataFrame, s: Settings) -> DataFrame:
    """Stages after generation, on rows as ``with_template`` leaves them: ``evidence``, then a prudent answer where evidence
    is missing, then validation; ``generation_reject`` stays null for what can go on."""
    g = F.col("generation")
    support = Q.evidence_support(g["cluster_intent_statement"], g["knowledge_statement"], g["canonical_question"], g["canonical_answer"], F.col("questions"), F.col("answers"))
    staged = written(
        clusters.withColumn("evidence", support).withColumn("question_valid", Q.is_valid_question(g["canonical_question"], s))
        .withColumn("prudent_valid", Q.is_valid_answer(F.col("prudent_answer"), s)).withColumn("asked_valid", Q.is_valid_question(F.col("prudent_question"), s)), "evidence",
    )
    can = F.col("evidence.hard_reject") & g["publish"] & (F.size("categories") > 0) & F.col("prudent_valid") & (F.col("question_valid") | F.col("asked_valid"))
    staged = staged.withColumn("recovered", F.coalesce(can, F.lit(False)))
    pick = lambda name, new: F.when(F.col("recovered"), new).otherwise(g[name]).alias(name)
    asked = F.when(F.col("question_valid"), g["canonical_question"]).otherwise(F.col("prudent_question"))
    fixed = F.struct(
        g["publish"].alias("publish"), g["cluster_intent_statement"].alias("cluster_intent_statement"), pick("knowledge_statement", F.col("prudent_answer")), pick("canonical_question", asked),
        pick("canonical_answer", F.col("prudent_answer")), pick("confidence", F.least(g["confidence"], F.lit(0.62))), g["reason"].alias("reason"),
    )
    staged = written(staged.withColumn("generation", fixed), "fixed")
    reason = F.when(F.col("evidence.hard_reject") & ~F.col("recovered"), F.col("evidence.reason")).otherwise(Q.generation_reject_reason(F.col("generation"), s))
    staged = written(staged.withColumn("generation_reason", reason), "validated")
    kind = Q.can_keep_for_review(F.col("generation.publish"), F.col("generation.canonical_question"), F.col("generation_reason"), s)
    kept = F.when(F.col("generation_reason").isNull(), F.lit("full_faq")).otherwise(kind)
    return staged.withColumn("candidate_kind", kept).withColumn("generation_reject", F.when(F.col("candidate_kind").isNull(), F.col("generation_reason")))
