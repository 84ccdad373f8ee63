import datetime

from recurq import cli, queries
from recurq.config import Settings
from recurq.operators import ingest, review, runs
from recurq.plans import pipeline
from recurq.sources import io
from recurq.sources.store import Store
from recurq.streaming.pairs import streamed_pairs

MESSAGES = "conversation_pk long, message_pk long, workspace_id long, role string, content_text string, created_at timestamp_ntz"


def talk(questions, reply, workspace=1, first=0):
    rows = []
    for k, q in enumerate(questions):
        t = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=first + k)
        rows += [(first + k, (first + k) * 10, workspace, "user", q, t), (first + k, (first + k) * 10 + 1, workspace, "assistant", reply, t + datetime.timedelta(minutes=1))]
    return rows


def test_a_repeated_question_becomes_a_candidate(spark):
    asked = ["Quiero agendar una clase de prueba", "Necesito agendar una clase de prueba", "Quisiera agendar una clase de prueba ya"]
    rows = talk(asked, "Las clases de prueba se agendan desde la pagina de horarios del negocio.") + talk(["hola", "gracias"], "con gusto", first=50) + talk(["Tienen parqueadero para bicicletas grandes"], "El local tiene parqueadero cubierto para bicicletas.", first=90)
    messages = spark.createDataFrame(rows, MESSAGES)
    known = spark.createDataFrame([(2, "¿Cómo puedo agendar una clase de prueba?")], "workspace_id long, question string")
    s = Settings(algorithm="dbscan")
    got = pipeline.run(messages, known, s)
    (c,) = got.candidates.collect()
    assert c.reject_reason is None, c
    assert c.normalized_question == "¿Cómo puedo agendar una clase de prueba?"
    assert c.recurrence_count == 3 and c.alignment.status == "strong_alignment" and len(c.examples) == 3
    counts = {(r.stage, r.reason): r.n for r in got.metrics.collect()}
    assert sum(n for (stage, _), n in counts.items() if stage == "question") == got.pairs.count() == 6
    assert counts["cluster_member", "noise"] == 1
    same = known.selectExpr("1L AS workspace_id", "question")
    (again,) = pipeline.candidates_of(got.clusters, same, s).collect()
    assert again.reject_reason == "duplicate_of_faq"


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = runs.start(spark, path, {"a": 1})
    runs.finish(spark, path, run, "succeeded")
    (row,) = runs.latest(spark.read.schema(runs.LOG).parquet(path)).collect()
    assert (row.run_id, row.status, row.parameters) == (run, "succeeded", '{"a": 1}') and row.finished_at >= row.started_at


def test_streamed_pairs(spark, tmp_path):
    rows = talk(["a", "b"], "r") + [(7, 70, 1, "user", "first", datetime.datetime(2024, 1, 2)), (7, 71, 1, "user", "second", datetime.datetime(2024, 1, 3)), (7, 72, 1, "assistant", "x", datetime.datetime(2024, 1, 4)), (7, 73, 1, "assistant", "y", datetime.datetime(2024, 1, 5))]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
    q = streamed_pairs(source).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_text, r.assistant_text) for r in spark.sql("SELECT * FROM streamed").collect()}
    assert got == {("a", "r"), ("b", "r"), ("second", "x")}


def test_the_analysis_takes_all_messages(spark, monkeypatch):
    class Large:
        def __init__(self, spark, d):
            self.msgs = spark.range(60_000).selectExpr("id AS conversation_pk", "id AS message_pk", "1L AS workspace_id", "'user' AS role", "'a' AS content_text", "timestamp_ntz'2024-01-01' AS created_at")
            self.faqs = spark.createDataFrame([], "workspace_id long, question string, is_active boolean")

    monkeypatch.setattr(queries, "Clean", Large)
    monkeypatch.setattr(pipeline, "run", lambda messages, known, s: s)
    assert queries.analysis(spark, "").message_limit >= 60_000


def test_candidates_carry_the_most_common_agent(spark):
    asked = ["Quiero agendar una clase de prueba", "Necesito agendar una clase de prueba", "Quisiera agendar una clase de prueba ya"]
    rows = talk(asked, "Las clases de prueba se agendan desde la pagina de horarios del negocio.")
    agents = {0: "a", 1: "b", 2: "b"}
    messages = spark.createDataFrame([(*r, agents[r[0]]) for r in rows], MESSAGES + ", agent_id string")
    known = spark.createDataFrame([], "workspace_id long, question string")
    (c,) = pipeline.run(messages, known, Settings(algorithm="dbscan")).candidates.collect()
    assert c.agent_id == "b" and c.recurrence_count == 3


def test_ingest_puts_rows_in_by_key(spark):
    first = spark.createDataFrame([("m2", "user", 1, datetime.datetime(2024, 1, 2)), ("m1", "user", 2, datetime.datetime(2024, 1, 1)), (None, "user", 1, None)], "id string, role string, workspace_id int, created_at timestamp_ntz")
    once = ingest.ingest({}, {"messages": first})
    assert sorted((r.id, r.role, r.message_pk) for r in once["messages"].collect()) == [("m1", "user", 1), ("m2", "user", 2)]
    later = spark.createDataFrame([("m2", "assistant", 1, datetime.datetime(2024, 1, 2)), ("m0", "user", 1, datetime.datetime(2024, 1, 3)), ("m0", "user", 1, datetime.datetime(2024, 1, 3))], first.schema)
    twice = ingest.ingest(once, ingest.selected({"messages": later}, workspace_id=1, since=datetime.datetime(2024, 1, 2)))
    assert sorted((r.id, r.role, r.message_pk) for r in twice["messages"].collect()) == [("m0", "user", 3), ("m1", "user", 1), ("m2", "assistant", 2)]
    assert ingest.ingest(twice, {"messages": later.limit(0)})["messages"].count() == 3


def test_a_second_run_supersedes_and_its_candidate_is_promoted(spark):
    asked = ["Quiero agendar una clase de prueba", "Necesito agendar una clase de prueba", "Quisiera agendar una clase de prueba ya"]
    rows = talk(asked, "Las clases de prueba se agendan desde la pagina de horarios del negocio.")
    messages = spark.createDataFrame([(*r, "a") for r in rows], MESSAGES + ", agent_id string")
    none = spark.createDataFrame([], "workspace_id long, question string")
    s = Settings(algorithm="dbscan")
    got = pipeline.run(messages, none, s)
    table = pipeline.persisted(None, got.candidates, datetime.datetime(2024, 2, 1))
    (first,) = table.collect()
    assert not first.superseded_previous_candidate
    # the same question again: the open candidate is updated, not repeated
    again = pipeline.candidates_of(got.clusters, none, s, earlier=table)
    (second,) = pipeline.persisted(table, again, datetime.datetime(2024, 3, 1)).collect()
    assert second.superseded_previous_candidate and (second.candidate_id, second.created_at) == (first.candidate_id, first.created_at)
    # a near question of an earlier candidate stops it; one that was rejected, too, unless rejected ones are let in
    near = spark.createDataFrame([(1, "¿Cómo puedo agendar la clase de prueba?", "rejected")], "workspace_id long, normalized_question string, status string")
    (c,) = pipeline.candidates_of(got.clusters, none, s, earlier=near).collect()
    assert c.reject_reason == "duplicate_of_candidate"
    (c,) = pipeline.candidates_of(got.clusters, none, Settings(algorithm="dbscan", skip_rejected=False), earlier=near).collect()
    assert c.reject_reason is None
    # a rejected candidate stays as it was, next to the one of the next run
    rejected = table.drop("status").selectExpr("*", "'rejected' AS status")
    both = pipeline.persisted(rejected, got.candidates, datetime.datetime(2024, 3, 1)).collect()
    assert len({r.candidate_id for r in both}) == 2 and sorted(r.status == "rejected" for r in both) == [False, True]
    # approved, it becomes a known question, which the next run finds
    events = review.decisions(table, spark.createDataFrame([(first.candidate_id, "approved", "eva", 1)], "candidate_id string, status string, reviewer string, at int"))
    edits = review.edit_events(table, spark.createDataFrame([], "candidate_id string, question string, answer string, editor string, at int"))
    faqs = review.promoted(review.state(table, edits, events))
    (faq,) = faqs.collect()
    assert (faq.question, faq.agent_id) == (first.normalized_question, "a")
    (c,) = pipeline.candidates_of(got.clusters, faqs.select("workspace_id", "question"), s).collect()
    assert c.reject_reason == "duplicate_of_faq"


def test_command_line_ingest(spark, sf_dir, tmp_path):
    out = str(tmp_path)
    cli.main([sf_dir, out, "--ingest", "--dry-run"])
    assert not io.has_table(spark, f"{out}/clean/messages")
    cli.main([sf_dir, out, "--ingest", "--agent", "agent-2-0"])
    some = {name: io.read_table(spark, f"{out}/clean/{name}") for name in ingest.TABLES}
    assert {r.workspace_id for r in some["messages"].select("workspace_id").distinct().collect()} == {2} and some["agents"].count() == 1
    cli.main([sf_dir, out, "--ingest"])
    all_rows = io.read_table(spark, f"{out}/clean/messages")
    c = queries.Clean(spark, sf_dir)
    assert all_rows.count() == c.msgs.count() == all_rows.select("message_pk").distinct().count()
    found = {r.metric_name: r.metric_value for r in spark.read.json(f"{out}/counters").collect()}
    assert found["messages_read"] == c.msgs.count() and found["user_assistant_pairs_built"] == spark.read.json(f"{out}/pairs").count() > 0
    kept = all_rows.join(some["messages"].select("id", some["messages"]["message_pk"].alias("before")), "id")
    assert kept.count() == some["messages"].count() and kept.filter("message_pk <> before").isEmpty()


def test_command_line_run(spark, sf_dir, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        cli.main([sf_dir, out, "--since", "2024-01-01"])
    log = runs.latest(spark.read.schema(runs.LOG).parquet(f"{out}/runs")).collect()
    assert [r.status for r in log] == ["succeeded"] * 2
    store = Store(spark, f"{out}/store")
    assert store.state().version == 2 and store.read("metrics").select("run_id").distinct().count() == 2
    table = io.read_table(spark, f"{out}/candidates")
    assert table.count() == table.select("candidate_id").distinct().count() == table.selectExpr("workspace_id", "agent_id", "lower(normalized_question)").distinct().count()
