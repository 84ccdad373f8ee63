import corpus_pipeline
from recurq.llm import language_id
from test_decontaminate import brute_pairs
from test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(7001, "123 456 !!", None, None, 10), (7002, None, "en", None, 0), (None, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    state = {(r.doc_id): r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = state
        df = corpus_pipeline.written(stage(spark, df, sf_dir), name)
        assert df.columns == docs.columns
        state = {r.doc_id: r.text for r in df.collect()}
        if name == "language":
            want = {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_copies":
            largest = {}
            for d, t in before.items():
                largest[t] = max(d, largest.get(t, d))
            want = set(largest.values())
        elif name == "near_copies":
            ids = list(before)
            want = set(brute_components([brute_fingerprint(before[d]) for d in ids], ids))
        else:
            leaks = {d for d, _ in brute_pairs(list(before.items()), items)}
            assert not set(state) & leaks or len(set(state) & leaks) <= 0.01 * len(leaks)
            want = set(before) - (leaks - set(state))
        assert set(state) == want, name
    out = corpus_pipeline.packed(spark, df, sf_dir).toPandas()
    assert set(out["doc_id"]) == set(state)
    assert out.groupby("bin")["size"].sum().max() <= 8192


def test_language_model_tells_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 100
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 2), (3, "12 !?", None, 3), (None, "the cat", "en", 4), (5, "le chat", "fr", 5), (5, "le chat " * 50000, None, 6), (6, "the dog", "en", 6)], "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 6
    nothing = language_id.identify_languages(df.filter("doc_id = 3")).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language_id.identify_languages(df.limit(0)).collect() == []


def test_known_words_come_before_ngrams():
    model = language_id.Model([(0, "abc", {"x": 5}), (0, "zzz", {"y": 5}), (2, "ab", {"y": 9}), (2, "zz", {"x": 9}), (1, "q", {"y": 3}), (1, "z", {"x": 3})], {(0, "x"): 5, (0, "y"): 5, (2, "y"): 9, (2, "x"): 9, (1, "y"): 3, (1, "x"): 3}, 4)
    known, backed, letter = model.word("abc"), model.word("abd"), model.word("q")
    assert known[0] > known[1]
    assert backed[1] > backed[0]
    assert letter[1] > letter[0]
    assert model.word("ww") is None


def test_leaks_with_an_edit_in_every_word_are_dropped(spark, tmp_path):
    items = ["kolmogor stellate brackish", "winterly marigold tangible overcast"]
    edited = ["kolm0gor stell0te brack0sh", "wint0rly mari0old tang0ble over0ast"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, f"some words before {t} and after") for k, t in enumerate(edited)] + [(9, "none of them is in here")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()] == [9]
