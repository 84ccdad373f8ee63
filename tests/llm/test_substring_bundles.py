import numpy as np
import pytest
from pyspark.sql import functions as F

from recurq.llm import substring_dedup as s


def test_keys_travel_in_bundles_and_the_filter_is_of_those_that_repeat(spark, sf_dir):
    source = s._numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").coalesce(1)
    sent = s._scan(source, 46, 3).select("h").collect()
    assert len(sent) <= 1 << s._PARTS  # one bundle; it was a row a key
    bundled = np.concatenate([np.frombuffer(r.h, np.uint64) for r in sent])
    assert len(bundled) > 4 * len(sent) and len(np.unique(bundled)) == len(bundled)
    keys = []
    for r in source.collect():
        data, offsets = s.buffers(s.pa.array([r.text], s.pa.string()))
        found = s.words(data, offsets, 0, 1)
        keys.append(s.keys_of(*s.shingles(found.hashes, found.first, s.SHINGLE), 46, 3)[0])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    assert key.tolist() == np.sort(bundled).tolist()
    for parts in (source, source.repartition(5)):
        dense = s._repeated(s._scan(parts, 46, 3))
        want = np.zeros_like(dense)
        np.bitwise_or.at(want, key[n > 1] >> np.uint64(64 - (s._FILTER_BITS - 6)), s._bits(key[n > 1]))
        assert (n > 1).any() and (dense == want).all()


@pytest.mark.parametrize("bundles", [1, 4])
def test_pairs_are_all_members_with_the_least(spark, bundles):
    rng = np.random.default_rng(21)
    rows = [(int(k) - (1 << 63), int(d) * 977, int(c)) for k, d, c in zip(rng.integers(0, 40, 3000) << 57, rng.integers(-300, 300, 3000), rng.integers(0, 90, 3000), strict=True)]
    rows += [(12345, 7, 3), (12345, 7 + (1 << 39), 5), (12346, 8, 1), (12346, 8, 2)]  # two that agree in the bits that rank them; one document alone

    def windows(batches):
        return s._windows((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches)

    hits = s.written(spark.createDataFrame(rows, "key long, doc long, centre int").repartition(bundles).mapInArrow(windows, s._WINDOWS), "windows")
    members = {}
    for k, d, c in rows:
        members.setdefault(k, set()).add((d & ((1 << 39) - 1), c, d))
    want = set()
    for some in members.values():
        _, m, other = min(some)
        want |= {(d, other, c << 32 | m) for _, c, d in some if d != other}
    got = s._pairs(hits, spread=True).collect()
    assert len({(r.doc_id, r.other) for r in got}) == len(got)
    tied = {(7, 7 + (1 << 39), 3 << 32 | 5), (7 + (1 << 39), 7, 5 << 32 | 3)}
    got = {(r.doc_id, r.other, int(a)) for r in got for a in np.frombuffer(r.anchors, np.int64)}
    assert got - tied == want - tied and got & tied


def test_a_row_that_repeats_is_one_document_and_one_id_may_have_several_texts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("b", None), ("b", ""), (None, "x")], "id string, body string")
    got = s._numbered(df, "id", "body")
    assert sorted((r.id, r.text or "", r.text is None) for r in got.collect()) == [("a", "x", False), ("a", "y", False), ("b", "", False), ("b", "", True)]
    assert got.select(F.count_distinct("doc_id")).first()[0] == 4
