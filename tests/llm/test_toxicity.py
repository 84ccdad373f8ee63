import numpy as np

from recurq.llm import toxicity


def test_fit_recovers_the_order_of_grades():
    rng = np.random.default_rng(0)
    n = 600
    has = rng.random((n, 4)) < 0.3
    grades = np.clip(2 * has[:, 0] + has[:, 1], 0, 2).astype(int)
    rows, columns = np.nonzero(has)
    w, t = toxicity.fit_ordinal(rows, columns, grades, 4)
    assert t[1] > t[0]
    assert w[0] > w[1] > max(abs(w[2]), abs(w[3]))


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    learn, held = labels.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 = 0")
    model = toxicity.train(documents, learn)
    got = toxicity.severities(documents, model).join(held.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    truth, said = got["label"] == 1, got["toxic"]
    precision, recall = (said & truth).sum() / said.sum(), (said & truth).sum() / truth.sum()
    assert precision >= 0.9 and recall >= 0.8
    assert got.loc[truth, "expected_severity"].mean() > 10 * got.loc[~truth, "expected_severity"].mean()


def test_odd_rows(spark):
    documents = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "you stupid", 1), (4, "fine " * 30000, 0), (4, "fine", 0)], "doc_id long, text string, toxic int")
    assert [r.toxic for r in toxicity.severities(documents, None).collect()] == [False] * 5
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, "stupid clown here" if i % 4 == 0 else "a nice day out there") for i in range(100)], "doc_id long, text string")
    model = toxicity.train(train, labels)
    got = [r.toxic for r in toxicity.severities(documents, model).collect()]
    assert got == [False, False, True, False, False]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.train(empty, labels) is None
    assert toxicity.severities(empty, model).collect() == []
