"""Quality gates as columns: intents, validity, evidence, alignment, score and tier."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.functions import lexicon as L
from recurq.functions import text as T


def first_of(rules: list[tuple[Column, Column | str]], default: Column | None = None) -> Column:
    """The value of the first rule that holds."""
    start = F.lit(None) if default is None else default
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1]) if isinstance(r[1], str) else r[1]).otherwise(rest), reversed(rules), start)


def intents(question: Column) -> Column:
    """The sorted intents of one question."""
    return T.let(T.fold_text(question), intents_of_folded)


def intents_of_folded(folded: Column) -> Column:
    found = {name: T.has_any(folded, terms) for name, terms in L.INTENTS.items()}
    found["scheduling"] = found["scheduling"] | (folded.contains("reserv") & ~found["payment"])
    return F.array_compact(F.array(*[F.when(found[name], F.lit(name)) for name in sorted(found)]))


def intents_of(questions: Column) -> Column:
    """The sorted intents of an array of questions."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(questions, intents))))


def primary(categories: Column) -> Column:
    return F.array_except(categories, F.array(F.lit("pricing")))


def is_mixed(categories: Column) -> Column:
    return F.size(primary(categories)) > 1


def _shape(clean: Column, least: int, most: int, folded: Column | None = None) -> Column:
    return T.word_count(clean).between(least, most) & ~T.is_tool_trace(clean, folded) & ~T.has(clean, L.PLACEHOLDER) & ~T.has_emoji(clean)


def _with_folded(x: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the normalised and the folded text."""
    return T.let(T.normalize_text(x), lambda clean: T.let(T.fold_text(clean), lambda folded: body(clean, folded)))


def is_valid_question(x: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    starts = "|".join(r"\Q" + w + r"\E" for w in [*L.QUESTION_GREETINGS, *L.RAW_CHAT_STARTS])
    return _with_folded(x, lambda clean, folded: (
        F.char_length(clean).between(8, 180) & _shape(clean, 3, s.max_question_words, folded) & clean.rlike("[?¿]") & (clean.startswith("¿") | clean.contains("?")) & ~T.has_time_reference(clean, folded)
        & ~folded.rlike(f"^(?:{starts})") & ~T.has_any(folded, L.PERSONAL_MARKERS) & ~T.has(folded, r"\b(yo|me|mi|mis|conmigo|con mi)\b") & (F.regexp_count(folded, F.lit("[a-záéíóúñ]")) >= 6)
    ))


def is_valid_answer(x: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    return _with_folded(x, lambda clean, folded: (
        F.char_length(clean).between(20, 420) & _shape(clean, 5, s.max_answer_words, folded) & ~T.is_chat_style(clean, folded) & ~T.has(clean, r"https?://|www\.") & ~T.has_time_reference(clean, folded) & ~clean.contains("?")
        & ~T.has_any(folded, L.ANSWER_FORBIDDEN) & ~T.has(folded, r"\b(indica|indique|contacta|contacte|consulta|consulte|tienes|tengo|quieres|quiero|gustaria)\b") & ~folded.rlike("^(?:claro|aqui)")
    ))


def is_valid_statement(x: Column, most: int = 45) -> Column:
    """A knowledge statement; 55 words for a statement of intent."""
    return _with_folded(x, lambda clean, folded: (clean != "") & ~clean.contains("?") & _shape(clean, 4, most, folded))


def is_aligned(question: Column, answer: Column, statement: Column | None = None) -> Column:
    """Whether an answer is about the question."""
    said = F.concat_ws(" ", answer, F.coalesce(statement, F.lit("")) if statement is not None else F.lit(""))
    return T.let(T.fold_text(question), lambda q: T.let(T.fold_text(said), lambda a: _about(q, a)))


def _about(q: Column, a: Column) -> Column:
    conditional = q.contains("gratis") | T.has_any(q, ["desde", "valor minimo", "monto minimo"])
    free = a.contains("gratis")
    free_delivery = free & T.has_any(a, ["domicilio", "envio", "entrega"])
    price = free & T.has_any(q, ["precio", "cuanto cuesta", "cuanto vale", "valor"])
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\w{4,}"), F.lit(0))
    apart = (F.size(words(q)) > 0) & (F.size(words(a)) > 0) & ~F.arrays_overlap(words(q), words(a))
    return (q != "") & (a != "") & ~((free_delivery | price) & ~conditional) & ~apart


def is_prudent(answer: Column) -> Column:
    return T.has_any(T.fold_text(answer), L.PRUDENT_FRAGMENTS)


def evidence_support(intent: Column, statement: Column, question: Column, answer: Column, questions: Column, answers: Column) -> Column:
    """How far cleaned evidence supports a generated pair: level, reason, hard_reject, answer_review, overlap."""
    qs = F.filter(F.transform(questions, T.clean_question_evidence), lambda x: x != "")
    ans = F.filter(F.transform(answers, lambda a: T.clean_answer_evidence(a)), lambda x: x != "")
    return T.let(qs, lambda q: T.let(F.array_join(F.concat(q, ans), " "), lambda e: _supported(intent, statement, question, answer, q, e)))


def _supported(intent: Column, statement: Column, question: Column, answer: Column, qs: Column, evidence: Column) -> Column:
    """``evidence_support`` from the cleaned questions and all cleaned evidence as one text."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    amounts = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d[\d.,]*"), F.lit(0)))
    said = F.concat_ws(" ", *[T.normalize_text(blank(x)) for x in (intent, statement, question, answer)])
    parts = F.struct(
        said.alias("said"), T.fold_text(said).alias("folded_said"), T.fold_text(evidence).alias("folded_evidence"), T.support_tokens(question).alias("q"),
        T.support_tokens(F.concat_ws(" ", blank(statement), answer)).alias("a"), T.support_tokens(evidence).alias("e"),
    )

    def facts(p: Column) -> Column:
        positive = T.has(p["folded_said"], r"\bsi\b") | T.has_any(p["folded_said"], L.POSITIVE_EVIDENCE[1:])
        negative = T.has(p["folded_evidence"], rf"\b({'|'.join(L.NEGATIVE_EVIDENCE)})\b")
        contradicted = positive & negative & F.arrays_overlap(T.support_tokens(p["said"]), p["e"])
        unknown_amount = F.size(F.array_except(amounts(p["folded_said"]), amounts(p["folded_evidence"]))) > 0
        asked = F.arrays_overlap(p["q"], T.support_tokens(F.array_join(qs, " "))) | (F.size(intents_of(qs)) > 0)
        overlap = F.when(F.size(p["a"]) > 0, F.size(F.array_intersect(p["a"], p["e"])) / F.size(p["a"])).otherwise(0.0)
        prudent = is_prudent(answer) & F.arrays_overlap(p["q"], p["e"])
        return F.struct(contradicted.alias("contradicted"), unknown_amount.alias("unknown_amount"), asked.alias("asked"), overlap.alias("overlap"), prudent.alias("prudent"))

    def result(level: str, reason: str, hard: bool, review: bool, ratio: Column | float = 0.0) -> Column:
        ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
        return F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), F.lit(hard).alias("hard_reject"), F.lit(review).alias("answer_review"), F.round(ratio, 4).alias("overlap"))

    none = result("none", L.REASONS["unsupported"], True, True)
    weak = result("weak", L.REASONS["answer_review"], False, True)

    def level(f: Column) -> Column:
        return first_of(
            [
                (f["contradicted"], none),
                (f["unknown_amount"] & f["asked"], result("weak", L.REASONS["amount"], False, True)),
                (f["unknown_amount"], none),
                (f["overlap"] >= 0.55, result("strong", "", False, False, f["overlap"])),
                (f["overlap"] >= 0.25, result("partial", L.REASONS["partial"], False, True, f["overlap"])),
                (f["overlap"] > 0, result("weak", L.REASONS["answer_review"], False, True, f["overlap"])),
                (f["asked"], weak),
                (f["prudent"], result("weak", L.REASONS["prudent"], False, True)),
            ],
            none,
        )

    return T.let(T.let(parts, facts), level)


def generation_reject_reason(g: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """The first check that a generated candidate fails, or null."""
    return first_of(
        [
            (~F.coalesce(g["publish"], F.lit(False)), "llm_publish_false"),
            (F.coalesce(g["confidence"], F.lit(0.0)) < s.min_confidence, "rejected_generation_confidence"),
            (~is_valid_statement(g["knowledge_statement"]), "rejected_invalid_knowledge_statement"),
            (~is_valid_question(g["canonical_question"], s), "rejected_invalid_canonical_question"),
            (~is_valid_answer(g["canonical_answer"], s), "rejected_invalid_canonical_answer"),
            (~is_aligned(g["canonical_question"], g["canonical_answer"], g["knowledge_statement"]), "rejected_question_answer_misaligned"),
        ],
        F.lit(None).cast("string"),
    )


RECOVERABLE = ["rejected_invalid_knowledge_statement", "rejected_invalid_canonical_answer", "rejected_question_answer_misaligned", "rejected_answer_not_supported_by_evidence"]


def can_keep_for_review(publish: Column, question: Column, reason: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """The kind of candidate that an imperfect generation may be kept as, or null."""
    kept = F.coalesce(publish, F.lit(False)) & is_valid_question(question, s) & reason.isin(RECOVERABLE)
    return F.when(kept, F.when(reason == RECOVERABLE[0], "full_faq").otherwise("question_with_answer_review"))


def alignment(question: Column, questions: Column, centroid_similarity: Column, average_similarity: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """How a canonical question fits its cluster: status, token_overlap, similarities."""
    clean = T.normalize_text(question)
    qs = F.filter(F.transform(questions, T.clean_question_evidence), lambda x: x != "")
    similarities = (F.round(centroid_similarity, 4), F.round(average_similarity, 4))
    return T.let(clean, lambda c: T.let(qs, lambda q: _aligned(c, q, *similarities, s)))


def _aligned(clean: Column, qs: Column, centroid_similarity: Column, average_similarity: Column, s: Settings) -> Column:
    """``alignment`` from the normalised question and the cleaned questions of the cluster."""
    parts = F.struct(
        T.support_tokens(clean).alias("tokens"), F.array_distinct(F.flatten(F.transform(qs, T.support_tokens))).alias("cluster_tokens"), intents_of(qs).alias("theirs"), intents(clean).alias("own")
    )
    nearest = F.greatest(centroid_similarity, average_similarity)

    def facts(p: Column) -> Column:
        theirs_primary, own_primary = primary(p["theirs"]), primary(p["own"])
        known = F.size(theirs_primary) > 0
        overlap = F.round(F.size(F.array_intersect(p["tokens"], p["cluster_tokens"])) / F.greatest(F.lit(1), F.least(F.size(p["tokens"]), F.lit(5))), 4)
        mismatch = known & (F.size(own_primary) > 0) & ~F.arrays_overlap(theirs_primary, own_primary)
        introduced = F.when(known, F.array_except(own_primary, theirs_primary)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            overlap.alias("overlap"), F.arrays_overlap(p["theirs"], p["own"]).alias("shared"), mismatch.alias("mismatch"), introduced.alias("introduced"), (F.size(p["theirs"]) == 0).alias("unknown")
        )

    def fitted(f: Column) -> Column:
        overlap, shared, mismatch, introduced = f["overlap"], f["shared"], f["mismatch"], f["introduced"]
        status = first_of(
            [
                ((clean == "") | (F.size(qs) == 0), "misaligned"),
                ((F.size(introduced) > 0) & (F.array_contains(introduced, "shipping") | (overlap < 0.5)), "misaligned"),
                (mismatch & (overlap < 0.25), "misaligned"),
                ((overlap >= 0.35) & ~mismatch, "strong_alignment"),
                ((nearest >= s.align_strong) & (shared | (overlap >= 0.2) | f["unknown"]) & ~mismatch, "strong_alignment"),
                (((nearest >= s.align_partial) | shared | (overlap > 0)) & ~(mismatch & (overlap == 0)), "partial_alignment"),
            ],
            F.lit("misaligned"),
        )
        return F.struct(status.alias("status"), overlap.alias("token_overlap"), centroid_similarity.alias("centroid_similarity"), average_similarity.alias("average_similarity"))

    return T.let(T.let(parts, facts), fitted)


def exact_score(recurrence: Column, cohesion: Column, confidence: Column, n_questions: Column, n_answers: Column) -> Column:
    """The score from 0 to 100 before it is rounded."""
    evidence = F.least(F.lit(1.0), (n_questions + n_answers) / F.greatest(F.lit(1), recurrence * 2))
    total = 0.30 * cohesion + 0.40 * confidence + 0.15 * F.least(F.lit(1.0), recurrence / 10) + 0.15 * evidence
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))


def score(recurrence: Column, cohesion: Column, confidence: Column, n_questions: Column, n_answers: Column) -> Column:
    return F.round(exact_score(recurrence, cohesion, confidence, n_questions, n_answers), 2)


def tier_reasons(confidence: Column, cohesion: Column, support: Column, n_answers: Column, earlier: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """The reasons for a review, each once, in order; none means high confidence."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(confidence, F.lit(0.0)) < s.high_confidence, F.lit(L.REASONS["confidence"])),
            F.when(cohesion < s.min_cohesion, F.lit(L.REASONS["cohesion"])),
            F.when(support < s.min_support, F.lit(L.REASONS["support"])),
            F.when(n_answers < 1, F.lit(L.REASONS["no_answers"])),
        )
    )
    return F.array_distinct(F.concat(F.coalesce(earlier, F.array().cast("array<string>")), found))


def tier(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "needs_review").otherwise("high_confidence")


def gate(size: Column, support: Column, cohesion: Column, mixed: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """The first gate that a cluster fails, or null; ``gate_reviews`` has what it passes with."""
    pair = (size == 2) & F.lit(s.two_example_clusters)
    return first_of(
        [
            ((size < s.min_cluster_size) & ~pair, "cluster_too_small"),
            (pair & (cohesion < s.two_example_cohesion), "two_example_cohesion"),
            (support < s.reject_support, "low_support"),
            (cohesion < s.hard_reject_cohesion, "low_cohesion"),
            (mixed & (size > 12), "mixed_intent"),
        ],
        F.lit(None).cast("string"),
    )


def gate_reviews(size: Column, support: Column, cohesion: Column, mixed: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    return F.array_compact(
        F.array(
            F.when(size == 2, F.lit("two_examples")),
            F.when(cohesion < s.reject_cohesion, F.lit("weak_cohesion")),
            F.when(support < s.min_support, F.lit("medium_support")),
            F.when(cohesion < s.min_cohesion, F.lit("medium_cohesion")),
            F.when(mixed, F.lit("mixed_intent")),
        )
    )
