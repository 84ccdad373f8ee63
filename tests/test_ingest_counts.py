from recurq.operators import ingest


def test_counts_of_two_ingests(spark):
    rows = [("a", "user", '{"role": "user", "content": "x"}'), ("a", "user", '{"role": "user", "content": "x"}'), ("b", "assistant", '{"role": "assistant", "content": " "}'), (None, "unknown", "no json"), ("c", "system", '{"role": "system", "content": "x"}')]
    messages = spark.createDataFrame(rows, "id string, role string, message string")
    counts = {}
    once = ingest.ingest({}, {"messages": messages}, counts)
    assert counts["messages"] == {"read": 5, "written": 3, "duplicates": 1, "user_messages": 2, "assistant_messages": 1, "messages_skipped_invalid_json": 1, "messages_skipped_empty_text": 1}
    assert sorted(r.id for r in once["messages"].collect()) == ["a", "b", "c"]
    found = ingest.figures(counts, pairs=4)
    assert (found["messages_read"], found["agents_read"], found["records_written"], found["records_omitted"], found["duplicates_omitted"], found["user_assistant_pairs_built"]) == (5, 0, 3, 2, 1, 4)
    again = {}
    assert ingest.ingest(once, {"messages": messages}, again)["messages"].count() == 3 and again == counts
    empty = {}
    assert ingest.ingest({}, {"messages": messages.limit(0)}, empty)["messages"].count() == 0 and set(empty["messages"].values()) == {0}
    plain = {}
    ingest.ingest({}, {"messages": messages.select("id", "role")}, plain)
    assert plain["messages"] == {"read": 5, "written": 3, "duplicates": 1}
