"""Each kind of rule with a row that breaks it and one that does not."""

import pytest

from recurq.sources import constraints as K


def made(spark, name, rows):
    """A table of ``rows``, dicts; what they leave out is filled so that it breaks nothing."""
    fill = {"long": 1, "int": 1, "string": "x", "boolean": True, "timestamp": "2025-01-01"}
    columns = [c for c in K.TABLES[name].parsed() if not c[1].startswith("array")]
    values = [tuple(str(v) if (v := r.get(c, fill.get(k) if required else None)) is not None else None for c, k, _, required in columns) for r in rows]
    return K.conformed(spark.createDataFrame(values, ", ".join(f"{c} string" for c, *_ in columns)), name)


def broken(**tables):
    return sorted((r.table_name, r.rule, r.key, r.n) for r in K.violations(tables).collect())


def test_a_registry_without_broken_references(spark):
    for name, t in K.TABLES.items():
        columns = {c for c, *_ in t.parsed()}
        assert t.primary in columns and set(t.foreign) <= columns and set(t.foreign.values()) <= set(K.TABLES), name
        assert len(K.schema_of(name)) == len(columns)
    assert len(K.TABLES) == 14


def test_rules_of_rows(spark):
    runs = made(spark, "pipeline_runs", [
        {"run_id": "a", "status": "running"}, {"run_id": "b", "status": "lost"}, {"run_id": None, "status": "failed"}, {"run_id": "c", "status": "s" * 31},
        {"run_id": "d", "status": "succeeded", "started_at": "2025-01-02", "finished_at": "2025-01-01"}, {"run_id": "e", "status": "succeeded", "finished_at": "2025-01-01"},
    ])
    got = {(r.rule, r.key) for r in K.violations({"pipeline_runs": runs}).collect()}
    assert got == {("check: status", "b"), ("not_null: run_id", None), ("check: status", "c"), ("length: status", "c"), ("check: finished_after_started", "d")}


def test_keys(spark):
    rows = [("1", None, "Q", "pending"), ("2", None, "q", "approved"), ("3", None, "q", "rejected"), ("4", "a", "q", "pending"), ("4", "b", "q", "needs_review")]
    found = made(spark, "faq_candidates", [{"candidate_id": i, "agent_id": a, "normalized_question": q, "status": s} for i, a, q, s in rows])
    assert broken(faq_candidates=found) == [("faq_candidates", "unique: candidate_id", "4", 2), ("faq_candidates", "unique: workspace_id, coalesce(agent_id, ''), lower(normalized_question)", "1||q", 2)]
    embeddings = made(spark, "message_embeddings", [{"message_embedding_id": str(k), "message_pk": p, "embedding_model": m} for k, (p, m) in enumerate([(1, "a"), (1, "b"), (2, "a"), (1, "a")])])
    assert broken(message_embeddings=embeddings) == [("message_embeddings", "unique: message_pk, embedding_model", "1|a", 2)]


def test_parents(spark):
    spaces = made(spark, "workspaces", [{"workspace_id": 1}])
    agents = made(spark, "agents", [{"agent_id": "a", "workspace_id": 1}, {"agent_id": "b", "workspace_id": 9}, {"agent_id": "c", "workspace_id": 9}])
    assert broken(agents=agents) == []
    assert broken(agents=agents, workspaces=spaces) == [("agents", "foreign: workspace_id", "9", 2)]
    faqs = made(spark, "existing_faqs", [{"faq_id": "f", "agent_id": "z", "workspace_id": None}, {"faq_id": "g", "agent_id": None}])
    assert broken(agents=agents, workspaces=spaces, existing_faqs=faqs) == [("agents", "foreign: workspace_id", "9", 2), ("existing_faqs", "foreign: agent_id", "z", 1)]


@pytest.mark.parametrize("name", K.TABLES)
def test_empty_tables_break_nothing(spark, name):
    assert K.violations({name: spark.createDataFrame([], K.schema_of(name))}).collect() == []
