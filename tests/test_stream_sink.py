import pytest

from recurq.sources.store import Store
from recurq.streaming import sink

ROWS = "id string, role string, content_text string"


def shown(store):
    return sorted((r.id, r.role, r.content_text) for r in sink.newest(store, "messages").collect())


def test_replayed_batches_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert sink.newest(store, "messages") is None and sink.compacted(store, "messages").version == 0
    first = frame([("a", "user", "x"), ("a", "user", "x"), ("b", "user", None), (None, "user", "lost")])
    sink.put_batch(store, "messages", "chat", first, 0)
    sink.put_batch(store, "messages", "chat", frame([("a", "user", "y"), ("c", "user", "z")]), 1)
    want = [("a", "user", "y"), ("b", "user", None), ("c", "user", "z")]
    assert shown(store) == want
    held = store.state()
    for number in (0, 1):
        assert sink.put_batch(store, "messages", "chat", first, number) == held
    # after a compaction keys are numbered, and a replay still changes nothing
    sink.compacted(store, "messages")
    keys = {r.id: r.message_pk for r in store.read("messages").collect()}
    assert shown(store) == want and sorted(keys.values()) == [1, 2, 3] and store.read("messages_log") is None
    assert sink.put_batch(store, "messages", "chat", first, 1).version == 3
    sink.put_batch(store, "messages", "other", frame([("a", "user", "w"), ("d", "user", "v")]), 0)
    assert shown(store) == [("a", "user", "w"), *want[1:], ("d", "user", "v")]
    assert {r.id: r.message_pk for r in sink.newest(store, "messages").collect()} == keys | {"d": None}
    sink.compacted(store, "messages")
    assert {r.id: r.message_pk for r in store.read("messages").collect()} == keys | {"d": 4}


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path, monkeypatch):
    store, source, at = Store(spark, str(tmp_path / "s")), str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        rows = spark.readStream.schema(ROWS).parquet(source)
        q = sink.sink(rows, store, "messages", "chat", at, lambda b: b.filter("role <> 'system'")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress

    put = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
    put([("a", "user", "x"), ("s", "system", "x")])
    run()
    assert shown(store) == [("a", "user", "x")]
    # the second batch is committed, but the stream dies before its checkpoint has it
    real = sink.put_batch

    def dies(*args):
        real(*args)
        raise OSError("lost")

    put([("b", "user", "y")])
    monkeypatch.setattr(sink, "put_batch", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    held = store.state()
    assert held.version == 2
    monkeypatch.setattr(sink, "put_batch", real)
    run()
    assert store.state() == held and shown(store) == [("a", "user", "x"), ("b", "user", "y")]
