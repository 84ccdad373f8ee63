import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.functions import text as T
from recurq.functions import vectors as V
from recurq.operators import cluster as C
from recurq.operators import dedup, examples, normalize, pairing, review
from recurq.operators.components import connected_components
from recurq.sources import io


def state_machine(rows):
    """(pairs, unanswered) of one conversation's (pk, role, text) rows."""
    waiting, out, lost = None, [], 0
    for pk, role, text in rows:
        if not (text or "").strip(" "):
            continue
        if role == "user":
            lost += waiting is not None
            waiting = pk
        elif role == "assistant" and waiting is not None:
            out.append((waiting, pk))
            waiting = None
    return out, lost + (waiting is not None)


def test_pairing_equals_the_state_machine(spark):
    rng = random.Random(1)
    rows = [(c, c * 100 + k, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", " ", "ok", None])) for c in range(30) for k in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, "conv long, message_pk long, role string, content_text string")
    got = {(r.message_pk, r.assistant_pk) for r in pairing.pairs(df, "conv", ["message_pk"]).collect()}
    per = [state_machine([(pk, role, t) for c, pk, role, t in rows if c == conv and role != "system"]) for conv in range(30)]
    assert got == {p for pairs, _ in per for p in pairs}
    stats = pairing.pair_stats(df, "conv", ["message_pk"]).first()
    assert (stats.pairs, stats.unanswered) == (len(got), sum(n for _, n in per))


def test_truncation_keeps_whole_conversations(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (2, 6), (2, 7), (3, 9)], "c long, at long")
    kept = pairing.truncated(df, "c", "at", 5)
    assert sorted(r.c for r in kept.collect()) == [2, 2, 2, 3]
    m = pairing.truncation_metrics(df, kept, "c").first()
    assert (m.truncated, m.truncated_ratio) == (True, round(1 - 4 / 6, 4))
    assert [r.c for r in pairing.truncated(df.filter("c = 2"), "c", "at", 1).collect()] == [2, 2, 2]


def test_message_shapes(spark):
    cases = {
        '{"role":"user","content":[{"type":"text","text":{"value":" a "}},{"text":"b"}]}': ("a\nb", "extracted"),
        '{"role":"user","content":"hola"}': ("hola", "extracted"),
        '{"role":"user","content":{"text":{"value":"x"}}}': ("x", "extracted"),
        '{"role":"user","text":"t"}': ("t", "extracted"),
        '{"role":"user","content":[]}': (None, "empty"),
        '{"role":"user"}': (None, "empty"),
        '{"role":"user","content":[{"image":1}]}': (None, "failed"),
        "not json": (None, "empty"),
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string").withColumn("t", normalize.content_text(F.col("m")))
    got = {r.m: (r.t, r.s) for r in df.withColumn("s", normalize.extraction_status(F.col("m"), F.col("t"))).collect()}
    assert got == cases


def test_upsert_is_idempotent_and_keeps_keys(spark):
    old = spark.createDataFrame([("a", 1, 7), ("b", 2, 9)], "k string, v int, pk long")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    once = io.upsert(old, new, ["k"], "pk")
    want = [("a", 1, 7), ("b", 20, 9), ("c", 30, 10)]
    read = lambda df: sorted((r.k, r.v, r.pk) for r in df.collect())
    assert read(once) == want
    assert read(io.upsert(once, new, ["k"], "pk")) == want
    again = io.append_absent(old, old.unionAll(spark.createDataFrame([("z", 0, 1)], old.schema)), ["k"])
    assert again.count() == 3


def test_tables_swap_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    io.replace_table(spark.range(3).toDF("x"), path, spark)
    io.replace_table(spark.range(5).toDF("x"), path, spark)
    assert io.read_table(spark, path).count() == 5


def naive_dbscan(x, eps, least):
    n = len(x)
    near = [np.flatnonzero(x @ x[i] >= 1 - eps - 1e-12).tolist() for i in range(n)]
    labels, at = [-1] * n, 0
    for i in range(n):
        if labels[i] >= 0 or len(near[i]) < least:
            continue
        queue = [i]
        labels[i] = at
        while queue:
            p = queue.pop(0)
            if len(near[p]) >= least:
                for q in near[p]:
                    if labels[q] < 0:
                        labels[q] = at
                        queue.append(q)
        at += 1
    return labels


def test_dbscan_equals_the_naive_version():
    rng = np.random.default_rng(3)
    for least in (2, 3):
        x = rng.normal(size=(80, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert C.dbscan(x, 0.1, least).tolist() == naive_dbscan(x, 0.1, least)


def blobs(rng, k=3, n=12):
    centres = np.eye(k + 2)[:k]
    x = np.concatenate([c + rng.normal(scale=0.05, size=(n, k + 2)) for c in centres])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_hierarchies_find_separate_groups():
    x = blobs(np.random.default_rng(5))
    want = np.repeat([0, 1, 2], 12).tolist()
    assert C.agglomerative(x, 0.3, 2).tolist() == want
    labels = C.hdbscan(x, 3, 2)
    for k in range(3):
        part = labels[k * 12 : k * 12 + 12]
        assert len(set(part[part >= 0].tolist())) == 1
    assert len(set(labels[labels >= 0].tolist())) == 3
    assert C.cluster(x, Settings())[1] == "hdbscan"
    assert C.cluster(x[:0], Settings())[0].tolist() == []
    assert C.cluster(x, Settings(algorithm="dbscan"))[0].tolist() == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (7, 9), (2, 1)], "u long, v long")
    got = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert connected_components(edges.limit(0)).collect() == []


def test_similar_pairs_and_nearest(spark):
    x = blobs(np.random.default_rng(6), n=6)
    df = spark.createDataFrame([(i, f"g{i % 2}", v.tolist()) for i, v in enumerate(x)], "id long, g string, v array<double>")
    got = {(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.9, "g", block_rows=4).collect()}
    want = {(i, j) for i in range(18) for j in range(i + 1, 18) if i % 2 == j % 2 and x[i] @ x[j] >= 0.9}
    assert got == want
    best = {r.id: r.best for r in V.nearest(df.filter("id < 9"), df.filter("id >= 9"), "id", "v", "g").collect()}
    for i in range(9):
        assert abs(best[i] - max(x[i] @ x[j] for j in range(9, 18) if j % 2 == i % 2)) < 1e-9


def test_hash_vectors():
    v = V.hash_vector("una clase de prueba")
    assert abs(np.linalg.norm(v) - 1) < 1e-9 and (v == V.hash_vector("prueba de una clase")).all()
    assert not V.hash_vector("").any()


def test_dedup_and_merge(spark):
    new = spark.createDataFrame([(1, 7, "Como puedo reservar una clase", [1.0, 0.0]), (2, 7, "Otra cosa", [0.0, 1.0]), (3, 8, "Como puedo reservar una clase", [1.0, 0.0])], "id long, w long, q string, v array<double>")
    faqs = spark.createDataFrame([(7, "¿Cómo puedo reservar una clase", [0.9, 0.4358898943540673])], "w long, q string, v array<double>")
    names = {"key": "id", "question": "q", "vector": "v", "within": "w"}
    assert sorted(r.id for r in dedup.against_faqs(new, faqs, **names).collect()) == [2, 3]
    kept = dedup.against_candidates(new, faqs, **names).collect()
    assert {r.id: r.superseded_previous_candidate for r in kept} == {1: True, 2: False, 3: False}
    row = "candidate_id string, workspace_id long, agent_id string, normalized_question string, status string, created_at long"
    old = spark.createDataFrame([("a", 1, None, "Q uno", "pending", 1), ("b", 1, None, "q dos", "rejected", 1)], row)
    fresh = spark.createDataFrame([("x", 1, None, "q UNO", "needs_review", 2), ("y", 1, None, "q dos", "pending", 2)], row)
    got = sorted((r.candidate_id, r.status, r.created_at) for r in dedup.merge_candidates(old, fresh).collect())
    assert got == [("a", "needs_review", 1), ("b", "rejected", 1), ("y", "pending", 2)]


def test_review(spark):
    c = spark.createDataFrame([("a", 1, "ag", "q", "ans", "pending"), ("b", 1, None, "q2", "ans", "pending")], "candidate_id string, workspace_id long, agent_id string, normalized_question string, suggested_answer string, status string")
    edits = review.edit_events(c, spark.createDataFrame([("a", "nueva", None, "ana", 1), ("a", " ", None, "ana", 2), ("b", "q2", None, "ana", 1)], "candidate_id string, question string, answer string, editor string, at int"))
    assert {(r.candidate_id, r.error) for r in edits.collect()} == {("a", "blank"), ("a", None)}
    d = review.decisions(c, spark.createDataFrame([("a", "approved", "eva", 3), ("b", "approved", "eva", 3)], "candidate_id string, status string, reviewer string, at int"))
    assert {r.candidate_id: r.error for r in d.collect()} == {"a": None, "b": "cannot_promote"}
    s = review.state(c, edits, d)
    assert {(r.candidate_id, r.status, r.normalized_question, r.edit_count) for r in s.collect()} == {("a", "approved", "nueva", 1), ("b", "pending", "q2", 0)}
    assert [r.question for r in review.promoted(s).collect()] == ["nueva"]


def test_settings():
    s = Settings.from_env(env={"RECURQ_EPS": "0.2", "RECURQ_SKIP_REJECTED": "no", "RECURQ_MIN_CLUSTER_SIZE": "x"})
    assert (s.eps, s.skip_rejected, s.min_cluster_size) == (0.2, False, 3)
    for bad in ({"look_back_days": 0}, {"message_limit": 0}, {"algorithm": "k"}):
        try:
            Settings(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_eligible_window(spark):
    t = datetime.datetime(2024, 1, 5)
    df = spark.createDataFrame([("user", "a", t), ("user", "a", t - datetime.timedelta(days=9)), ("tool", "a", t), ("assistant", " ", t)], "role string, content_text string, created_at timestamp_ntz")
    assert pairing.eligible(df, t, 3).count() == 1


def test_text_of_a_dry_run():
    text = normalize.dry_run_text
    assert text('{"content": [{"type": "text", "text": {"value": " a  b "}}, {"type": "image", "text": "no"}, {"text": "c"}, "d"]}') == "a b c d"
    assert text('{"content": {"message": {"value": "m"}}}') == "m" and text('{"content": " ", "transcript": "t"}') == "t"
    # the parts of known types only, though the message has another text
    assert text('{"content": [{"type": "image", "text": "no"}], "text": "other"}') == ""
    assert text("not  json") == "not json" and text('"x"') == "x" and text(None) == text("3") == text("") == ""
    assert text("[" * 100_000) == "[" * 100_000


def test_examples_against_brute_force(spark):
    rng = random.Random(4)
    asked = ["Quiero una clase", "quiero una clase", "Horario del lunes", "Precio de la clase", "", "Donde queda la sede", "Precio mensual"]
    rows = [(g, i, rng.choice(asked)) for g in range(6) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g int, i int, t string")
    clean = {r.i_g: (r.e, r.q) for r in df.select(F.struct("g", "i").alias("i_g"), T.clean_question_evidence("t").alias("e")).select("i_g", "e", T.normalize_question("e").alias("q")).collect()}
    want = {}
    for g, i, _ in rows:
        example, question = clean[g, i]
        if example == "":
            continue
        taken, seen, repeats = want.get(g, ([], set(), 0))
        if len(taken) < 3:
            taken, seen, repeats = (taken, seen, repeats + 1) if question in seen else ([*taken, example], seen | {question}, repeats)
        want[g] = (taken, seen, repeats)
    got = {r.g: (r.examples, r.duplicates) for r in examples.first_examples(df, ["g"], "t", "i").collect()}
    assert got == {g: (taken, repeats) for g, (taken, _, repeats) in want.items()}
    answers = spark.createDataFrame([(1, k, a) for k, a in enumerate(["Las clases se agendan en la pagina web.", "Otra respuesta que es larga de verdad.", "Las clases se agendan en la pagina web.", "corta"])] + [(2, 9, "corta")], "g int, i int, t string")
    got = {r.g: r.answer for r in examples.most_common_answer(answers, ["g"], "t", "i").collect()}
    assert got[1].startswith("Las clases se agendan") and got[2] == examples.UNSURE


def test_one_event_gives_question_and_answer(spark):
    c = spark.createDataFrame([("a", "q", "r", "pending")], "candidate_id string, normalized_question string, suggested_answer string, status string")
    edits = spark.createDataFrame([("a", "q1", "r2", "ana", 1, None), ("a", "q2", "r1", "eva", 1, None)], "candidate_id string, new_question string, new_answer string, editor string, at int, error string")
    none = spark.createDataFrame([], "candidate_id string, new_status string, reviewer string, at int, error string")
    (r,) = review.state(c, edits, none).collect()
    assert (r.normalized_question, r.suggested_answer, r.last_edited_by, r.status) == ("q2", "r1", "eva", "pending")


def test_components_take_no_round_more_than_they_need(spark, monkeypatch):
    """Edges that hang on the least already take none; others stop as soon as they do."""
    from recurq.operators import components

    steps, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a: steps.append(1) or star(*a))
    stars = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(1000, k) for k in range(1001, 1010)], "u long, v int")
    got = {r.vertex: r.component for r in connected_components(stars).collect()}
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1010)}
    assert steps == []
    chain = spark.createDataFrame([(5, 7), (7, 9), (2, 9), (11, 12)], "u long, v long")
    assert {r.vertex: r.component for r in connected_components(chain).collect()} == {2: 2, 5: 2, 7: 2, 9: 2, 11: 11, 12: 11}
    assert len(steps) == 4
