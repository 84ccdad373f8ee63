"""Extra columns with clashing names, repeated rows, odd texts and empty tables through every operator."""

import corpus_pipeline
import pytest
from recurq.llm import decontaminate, exact_dedup, language_id, packing, queries, secret_scan, sharding, simhash, substring_dedup, token_counts, toxicity

ITEMS = [(1, "what is the capital of the large country of this test"), (1, "what is the capital of the large country of this test"), (2, None)]
EXTRA = "__id long, __sha string, __h string, h string, sha string, fp long, rank long, block int, key string, kind int, row int, deal int, size string, item_id string, __hit int, __keep int, other string, lang_pred string"


def rows(repeats):
    texts = [None, "", "  ", "the cat sat on the mat", "\u00bd \u00b2\u00b3 \u2167", "x" * 300_000, "password = hunter2hunter2", ITEMS[0][1]]
    return [(k, t, "en" if k % 2 else None, None if k == 3 else "s", 1) for k, t in enumerate(texts)] * repeats + [(None, "the cat sat on the mat", None, None, None)]


def operators(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(8)], "doc_id long, toxic int, __id int")
    return {
        "token_counts": lambda df: token_counts.token_counts(df, queries._byte_bpe),
        "contaminated": lambda df: decontaminate.contaminated(df, items),
        "scan_documents": secret_scan.scan_documents,
        "near_duplicates": simhash.near_duplicates,
        "exact_dedup": exact_dedup.exact_dedup,
        "repeated_passages": substring_dedup.repeated_passages,
        "severities": lambda df: toxicity.severities(df, toxicity.train(df, labels)),
        "best_fit": packing.best_fit,
        "identify_languages": language_id.identify_languages,
        "shard_by_bytes": sharding.shard_by_bytes,
    }


@pytest.mark.parametrize("name", ["token_counts", "contaminated", "scan_documents", "near_duplicates", "exact_dedup", "repeated_passages", "severities", "best_fit", "identify_languages", "shard_by_bytes"])
def test_clashing_columns_and_empty_tables(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    plain = spark.createDataFrame(rows(2), schema)
    extra = EXTRA.split(", ")
    clashing = spark.createDataFrame([r + (None,) * len(extra) for r in rows(2)], f"{schema}, {EXTRA}")
    run = operators(spark)[name]
    one, two = run(plain), run(clashing)
    assert one.columns == two.columns
    if name not in ("best_fit", "shard_by_bytes"):  # equal rows may change places there
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    else:
        assert one.count() == two.count()
    assert run(clashing.limit(0)).collect() == []


def test_numerals_are_no_letters(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(spark.createDataFrame(rows(1), "doc_id long, text string, lang string, source string, n_chars int")).collect()}
    assert got[0] == got[1] == got[2] == got[4] == ("und", 0.0)
    assert got[3][0] == "en"


def test_repeated_rows_keep_one_and_are_dealt_to_all_blocks(spark):
    df = spark.createDataFrame([(7, "same text", "s")] * 3000 + [(6, "same text", "s")], "doc_id long, text string, source string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {7} and {r.group_size for r in got} == {3001}
    assert [tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()] == [(7, "same text", "s")]
    packed = packing.best_fit(df, block_rows=500).toPandas()
    assert len(packed) == 3001 and packed["bin"].is_unique
    assert (packed["bin"] // (1 << 32)).value_counts().max() < 1000


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    schema = f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}"
    df = spark.createDataFrame([r + (None,) * len(EXTRA.split(", ")) for r in rows(2)], schema)
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, df.limit(0), sf_dir).collect() == []
    out = run(spark, df, sf_dir)
    if stage != "packed":
        assert out.columns == df.columns
    assert out.count() > 0
