import datetime

import pytest
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.functions import text as T
from recurq.functions.vectors import hash_embedding
from recurq.operators import embeddings
from recurq.plans import persist, pipeline
from recurq.sources.store import Conflict, State, Store
from tests.test_plan import MESSAGES, talk


def test_versions_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.state() == State() and store.read("a") is None
    one = store.commit(State(), replace={"a": spark.range(3)}, append={"b": spark.range(2)}, marks={"m": "1"})
    two = store.commit(one, replace={"a": store.read("a").filter("id > 0")}, append={"b": spark.range(1).selectExpr("id", "'x' AS more")})
    assert (two.version, store.state().marks) == (2, {"m": "1"})
    assert store.read("a", one).count() == 3 and store.read("a").count() == 2
    assert sorted((r.id, r.more) for r in store.read("b").fillna("").collect()) == [(0, ""), (0, "x"), (1, "")]
    with pytest.raises(Conflict):
        store.commit(one, replace={"a": spark.range(9)})
    assert store.state() == two and store.read("a").count() == 2
    assert store.read("a", store.commit(two, replace={"a": None})) is None


def asked(spark, extra=()):
    texts = ["Quiero agendar una clase de prueba", "Necesito agendar una clase de prueba", "Quisiera agendar una clase de prueba ya", *extra]
    rows = talk(texts, "Las clases de prueba se agendan desde la pagina de horarios del negocio.")
    return spark.createDataFrame([(*r, "a") for r in rows], MESSAGES + ", agent_id string")


def test_a_run_is_committed_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    none, s = spark.createDataFrame([], "workspace_id long, question string"), Settings(algorithm="dbscan")
    store = Store(spark, str(tmp_path / "s"))
    first = persist.persist(store, pipeline.run(asked(spark), none, s), "r1", datetime.datetime(2024, 2, 1), since_days=365)
    (c,) = store.read("candidates").collect()
    counts = {r.table_name: r.n for r in persist.table_counts(store).collect()}
    assert counts["candidates"] == counts["clusters"] == counts["events"] == 1 and counts["examples"] == counts["embeddings"] == 3
    (event,) = store.read("events").collect()
    assert (event.candidate_id, event.event_type, event.previous_status, event.new_status) == (c.candidate_id, "created", None, c.status)
    metrics = {r.metric_name: r.metric_value for r in store.read("metrics").collect()}
    assert metrics["conversations_analyzed"] == metrics["faq_candidate_messages"] == metrics["embeddings_persisted"] == metrics["average_cluster_size"] == 3
    assert metrics["candidates_generated"] == metrics["clusters_valid"] == metrics["workspaces_processed"] == 1 and metrics["since_days"] == 365
    assert metrics["clusters_rejected"] == metrics["llm_rejected"] == metrics["validator_rejected"] == metrics["duplicates_omitted"] == 0

    later = pipeline.run(asked(spark, ["Deseo agendar una clase de prueba"]), none, s, earlier=store.read("candidates"))
    # the writer dies after any of its tables: the old version stays
    write = Store._written
    for n in (0, 2, 5):
        left = [n]

        def dies(self, name, df):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            return write(self, name, df)

        monkeypatch.setattr(Store, "_written", dies)
        with pytest.raises(OSError):
            persist.persist(store, later, "r2", datetime.datetime(2024, 3, 1))
        assert store.state() == first and {r.table_name: r.n for r in persist.table_counts(store).collect()} == counts
    monkeypatch.setattr(Store, "_written", write)
    done = persist.persist(store, later, "r2", datetime.datetime(2024, 3, 1))
    (again,) = store.read("candidates").collect()
    assert (again.candidate_id, again.created_at, again.recurrence_count) == (c.candidate_id, c.created_at, 4) and again.cluster_id != c.cluster_id
    shown = persist.current_examples(store).collect()
    assert len(shown) == 4 and {r.cluster_id for r in shown} == {again.cluster_id} and sorted(r.rank for r in shown) == [1, 2, 3, 4]
    counts = {r.table_name: r.n for r in persist.table_counts(store).collect()}
    # one new message was encoded, no second event was made, examples of the first run stay in its version
    assert (counts["embeddings"], counts["events"], counts["clusters"]) == (4, 1, 2) and persist.current_examples(store, first).count() == 3
    assert persist.persist(store, later, "r2", datetime.datetime(2024, 3, 1)) == done


def test_of_one_question_the_last_cluster_stays_for_review(spark):
    rows = [("c1", 1, None, "Q", 0, "needs_review"), ("c2", 1, None, "q", 4, "pending"), ("c3", 1, "a", "q", 1, "pending"), ("c4", 2, None, "q", 1, "pending")]
    made = spark.createDataFrame(rows, "candidate_id string, workspace_id long, agent_id string, normalized_question string, label int, status string")
    assert sorted((r.candidate_id, r.status) for r in persist.one_a_question(made).collect()) == [("c2", "needs_review"), ("c3", "pending"), ("c4", "pending")]
    assert persist.one_a_question(made.limit(0)).count() == 0


def test_only_unseen_messages_are_encoded(spark):
    schema = "message_pk long, text string, other string"
    rows = [(1, "hola mundo", "x"), (1, "hola mundo", "x"), (2, "otra cosa", "x"), (None, "sin clave", "x"), (3, None, "x"), (4, "...", "x"), (5, "", "x")]
    messages = spark.createDataFrame(rows, schema)
    vector = hash_embedding(16)(T.fold_text("text"))
    once = embeddings.delta(messages, None, "text", "m1", vector)
    assert sorted((r.message_pk, r.embedding_model, r.embedding_dimension) for r in once.collect()) == [(1, "m1", 16), (2, "m1", 16)]
    assert embeddings.delta(messages, once, "text", "m1", vector).count() == 0
    assert embeddings.delta(messages, once, "text", "m2", vector).count() == 2
    edited = messages.withColumn("text", F.when(F.col("message_pk") == 2, "otra cosa nueva").otherwise(F.col("text")))
    more = embeddings.delta(edited, once, "text", "m1", vector)
    assert [r.message_pk for r in more.collect()] == [2]
    held = embeddings.with_embeddings(edited.filter("message_pk < 4").distinct(), once.unionByName(more), "text", "m1")
    assert sorted((r.message_pk, r.embedding is None) for r in held.collect()) == [(1, False), (2, False), (3, True)]
    assert embeddings.delta(messages.limit(0), once, "text", "m1", vector).count() == 0
