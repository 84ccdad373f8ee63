import hashlib

from recurq.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, " "), (None, "only"), (None, "only"), (5003, "x" * 200_000), (5003, "x" * 200_000), (None, rows[0][1])]
    rows += [(6000 + k, "hot") for k in range(1200)]
    df = spark.createDataFrame([(i, t, "sha", 1) for i, t in rows], "doc_id long, text string, sha string, word int")
    got = exact_dedup.exact_dedup(df).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    texts = {t or "" for _, t in rows}
    assert sum(r.kept for r in got) == len(texts)
    assert len({r.text_sha256 for r in got if r.kept}) == len(texts)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_filter_never_misses(spark):
    df = spark.range(2000).selectExpr("xxhash64(id % 1500) AS h")
    words = exact_dedup.repeated_filter(df, "h", 16)  # so small that most bits are set
    hits = exact_dedup.with_hits(df, words, "h", 16)
    assert hits.filter("NOT __possibly_repeated").join(df.groupBy("h").count().filter("count > 1"), "h").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert exact_dedup.drop_exact_copies(empty).collect() == []
