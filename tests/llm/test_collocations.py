import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from recurq.llm import collocations as C
from recurq.llm import queries


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype(object))
    return sorted(con.execute(C.ORACLE).fetchall())


def corpus():
    rng = random.Random(3)
    words = ["The", "of", "new", "york", "city", "hall", "é", "x\x1cy", "\x01", "z\x0bz"]
    fixed = ["New York City Hall", "new york\tcity", "of the", "x\x1cy \x01", "of the new"]
    texts = []
    for _ in range(700):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 14))]
        texts.append("".join(p + rng.choice([" ", " ", "  ", ". ", "\n", ";"]) for p in parts))
    return [(k, t, rng.choice(["en", "en", "en", "de", None])) for k, t in enumerate(texts)] + [(None, None, "fr"), (1, "", None), (1, "b " * 40, "xx"), (1, "b " * 40, "xx")]


def same(got):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


@pytest.mark.parametrize(("shard_words", "part_bytes"), [(3_000_000, 8 << 20), (500, 2000)])
def test_equal_to_sql_in_one_shard_and_in_many(spark, shard_words, part_bytes):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "phrase").repartition(5)
    got = C.collocations(df, shard_words=shard_words, part_bytes=part_bytes, buckets=3)
    want = [(a, b, c, d, e, f, g, h) for a, b, c, d, e, f, g, h in by_sql(rows)]
    assert same(got.collect()) == want and len(want) > 20
    assert [f.name for f in got.schema.fields] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_full_filter_lets_more_through_and_changes_nothing(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = C.Filter.empty(10**9, 1024)
    assert len(few.bits) == 1024
    assert same(C.collocations(df, filter_bytes=1024).collect()) == by_sql(rows)


def test_filter_has_what_was_added():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = C.Filter.empty(4000, 1 << 26)
    f.add(h[:4000])
    assert f.has(h[:4000]).all() and f.has(h[4000:]).mean() < 0.02


def test_query_and_empty_tables(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(df).collect() == []
    rare = spark.createDataFrame([(1, "a b c", "en")], df.schema)
    assert C.collocations(rare).collect() == []
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert same(queries.op13_collocations(spark, sf_dir).collect()) == sorted(con.execute(C.ORACLE).fetchall())
