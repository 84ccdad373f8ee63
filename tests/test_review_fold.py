import random

from recurq.operators import review_fold
from recurq.operators.review import STATUSES

CANDIDATES = "candidate_id string, status string, agent_id string, normalized_question string, suggested_answer string, workspace_id int"
REQUESTS = "request_id long, candidate_id string, at int, status string, expected_status string, question string, answer string, actor string, notes string"


def by_hand(candidates, requests):
    """Each request in turn, on one candidate at a time."""
    now = {c[0]: list(c[1:5]) for c in candidates}
    out = {}
    for rid, cid, _, status, expected, question, answer, actor, _ in sorted(requests, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if cid not in now:
            out[rid] = ("not_found", None, None, None, None)
            continue
        s, agent, q, a = now[cid]
        given = [x for x in (question, answer) if x]
        new_q, new_a = (" ".join(question.split()) if question else q), (" ".join(answer.split()) if answer else a)
        edits = status is None or given
        if status is not None and status not in STATUSES:
            error = "unknown_status"
        elif expected is not None and expected != s:
            error = "conflict"
        elif edits and not ((actor or "").strip() and (new_q or "").strip() and (new_a or "").strip()):
            error = "blank"
        elif status == "approved" and not (agent and (new_a or "").strip()):
            error = "cannot_promote"
        else:
            error, now[cid] = None, [status or s, agent, new_q, new_a]
        out[rid] = (error, s, *[now[cid][k] for k in (0, 2, 3)])
    return out, now


def test_interleaved_requests_as_by_hand(spark):
    rng = random.Random(5)
    candidates = [(f"c{k}", rng.choice([*STATUSES, None, "odd"]), rng.choice(["x", None]), rng.choice(["q", ""]), rng.choice(["a", None, "  "]), k % 3) for k in range(12)]
    pick = lambda: rng.choice([None, "", "  ", "text  one", "two", "q", "a"])
    requests = [
        (k, rng.choice(["c0", "c0", "c1", *[f"c{j}" for j in range(13)], None]), rng.choice([None, *range(40)]), rng.choice([None, *STATUSES, *STATUSES, "lost"]), rng.choice([None, None, *STATUSES, "lost"]), pick(), pick(), rng.choice(["eva", "eva", "eva", " ", None]), "n")
        for k in range(700)
    ]
    rng.shuffle(requests)
    have, asked = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(requests, REQUESTS)
    want, end = by_hand(candidates, requests)
    for rows in (20, 100_000):  # c0 goes through many ranges, then all are in one
        folded = review_fold.fold(have, asked, rows).cache()
        got = {r.request_id: (r.error, r.previous_status, r.new_status, r.new_question, r.new_answer) for r in folded.collect()}
        assert got == want
        after = {r.candidate_id: [r.status, r.agent_id, r.normalized_question, r.suggested_answer] for r in review_fold.state(have, folded).collect()}
        assert after == end
    assert {e for e, *_ in want.values()} == {None, *review_fold.ERRORS[1:]}
    first = folded.filter("edited").orderBy("at", "request_id").first()
    assert (first.previous_question, first.previous_answer) != (first.new_question, first.new_answer) and first.error is None


def test_approval_promotes_and_reactivates(spark):
    have = spark.createDataFrame([("c1", "pending", "x", "q", "a", 1), ("c2", "pending", None, "q", "a", 1)], CANDIDATES)
    requests = [(1, "c1", 1, "approved", "pending", None, None, "eva", None), (2, "c1", 2, None, None, "later", None, "eva", None), (3, "c2", 1, "approved", None, None, None, "eva", None), (4, "c1", 3, "rejected", "pending", None, None, "ana", None)]
    folded = review_fold.fold(have, spark.createDataFrame(requests, REQUESTS))
    assert {r.request_id: r.error for r in folded.collect()} == {1: None, 2: None, 3: "cannot_promote", 4: "conflict"}
    faqs = spark.createDataFrame([("c1", "z", "z", 9, "old", "old", False), ("f", "z", "z", 9, "other", "b", True)], "faq_id string, source_agent_id string, agent_id string, workspace_id int, question string, answer string, is_active boolean")
    got = {r.faq_id: (r.agent_id, r.workspace_id, r.question, r.answer, r.is_active) for r in review_fold.promote(faqs, have, folded).collect()}
    assert got == {"c1": ("x", 1, "q", "a", True), "f": ("z", 9, "other", "b", True)}
    (c,) = review_fold.state(have, folded).filter("candidate_id = 'c1'").collect()
    assert (c.status, c.normalized_question, c.edit_count, c.last_edited_by, c.human_reviewed_by) == ("approved", "later", 1, "eva", "eva")


def test_repeated_rows_are_requests_each(spark):
    have = spark.createDataFrame([("c1", "pending", "x", "q", "a", 1)], CANDIDATES)
    asked = spark.createDataFrame([(7, "c1", 1, "rejected", "pending", None, None, "eva", None)] * 3, REQUESTS)
    assert sorted(str(r.error) for r in review_fold.fold(have, asked).collect()) == ["None", "conflict", "conflict"]


def test_nothing_to_fold(spark):
    have, none = spark.createDataFrame([("c1", "pending", "x", "q", "a", 1)], CANDIDATES), spark.createDataFrame([], REQUESTS)
    folded = review_fold.fold(have, none)
    assert folded.count() == 0 and review_fold.state(have, folded).first().status == "pending"
    assert review_fold.fold(have.limit(0), none).count() == 0


def test_one_shuffle_folds_what_a_task_can_walk(spark):
    candidates = [(f"c{k}", STATUSES[k % 4], "x" if k % 3 else None, f"q{k}", None if k % 5 == 0 else "a", 1) for k in range(40)]
    requests = [
        (k, f"c{0 if k % 3 == 0 else k % 41}" if k % 29 else None, k // 7, [None, *STATUSES][k % 5], STATUSES[k % 4] if k % 11 == 0 else None, ["", "new  text", None, " ", f"q{k % 41}"][k % 7 % 5], f"a {k}" if k % 2 else None, "eva", None)
        for k in range(1500)
    ]
    have, asked = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(requests, REQUESTS)
    want, end = by_hand(candidates, requests)
    for rows in (100, 100_000):  # c0 alone goes through ranges, then none does
        folded = review_fold.fold(have, asked, rows)
        assert {r.request_id: (r.error, r.previous_status, r.new_status, r.new_question, r.new_answer) for r in folded.collect()} == want
        assert {r.candidate_id: [r.status, r.agent_id, r.normalized_question, r.suggested_answer] for r in review_fold.state(have, folded).collect()} == end
    plan = review_fold.fold(have, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
