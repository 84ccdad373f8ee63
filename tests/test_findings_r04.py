"""Cases of the findings of round 4."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recurq import queries
from recurq.functions import text as T
from recurq.functions import vectors as V
from recurq.operators import cluster as C
from recurq.operators import cluster_scale as S
from recurq.operators import generate
from recurq.operators import quality as Q


def test_cluster_score_floors_before_it_rounds(spark, tmp_path):
    # 13 lines of one order with a score of 52.9969: two decimals make it 53.00
    lines = [(0.02, 0.06), (0.07, 0.01), (0.02, 0.01), (0.02, 0.07), (0.02, 0.06), (0.1, 0.08), (0.01, 0.07), (0.06, 0.05), (0.0, 0.05), (0.07, 0.06), (0.06, 0.03), (0.02, 0.02), (0.04, 0.02)]
    spark.createDataFrame([(7805, *x) for x in lines], "l_orderkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.cluster_score(spark, str(tmp_path)).collect()] == [(7805, 52)]


def _regexes(df) -> int:
    """How often a plan names a replacement by a pattern: each copy of a chain is evaluated anew."""
    return df._jdf.queryExecution().analyzed().toString().count("regexp_replace(")


def test_cluster_texts_are_cleaned_once(spark):
    df = spark.createDataFrame([(["¿Hacen envíos a Suba?", "envíos hoy"], ["Sí, hacemos envíos a toda la ciudad sin costo."])], "questions array<string>, answers array<string>")
    q, a = F.col("questions"), F.col("answers")
    one_question, one_answer = _regexes(df.select(T.clean_question_evidence(F.col("questions")[0]))), _regexes(df.select(T.clean_faq_answer(a[0])))
    assert _regexes(df.select(generate.intent_statement(q))) < 2 * one_question
    assert _regexes(df.select(Q.alignment(q[0], q, F.lit(0.0), F.lit(0.0)))) < 2 * one_question
    assert _regexes(df.select(T.clean_canonical_answer(a[0]))) < 2 * one_answer


def test_focus_tokens_of_many_questions(spark):
    words = ["camiseta", "gorra", "taza", "llavero", "bolsa", "cuadro"]
    asked = [" ".join(words[(k * j) % 6] + f" modelo{'abcdefgh'[k % 8]}" for j in range(1, 4)) for k in range(3000)]
    found = spark.createDataFrame([(asked,)], "q array<string>").select(generate.focus_tokens(F.col("q")).alias("t")).first().t
    per_question = [list(dict.fromkeys(q.split())) for q in asked]
    n = Counter(t for ts in per_question for t in ts)
    first = list(dict.fromkeys(t for ts in per_question for t in ts))
    assert found == sorted(first, key=lambda t: (-n[t], first.index(t)))[:4]


def test_hash_vectors_leave_in_slices():
    texts = pd.Series([f"texto {k}" for k in range(3000)] + [None])
    parts = list(V.hash_embedding(2048).func(iter([texts])))
    assert max(map(len, parts)) * 2048 * 8 <= V.OUT_BYTES
    rows = [r for part in parts for r in part]
    assert len(rows) == 3001 and not rows[3000].any() and all((rows[k] == V.hash_vector(f"texto {k}", 2048)).all() for k in (0, 255, 256, 2999))


def test_fragments_are_searched_as_bytes(spark):
    texts = ["", "los productos", "producto", "produc", "una gorra", "a.b", "axb", None, "pagó", "PAGO"]
    fragments = ["producto", "productos", "gorra", "a.b", "pago"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.has_any(F.col("t"), fragments).alias("x"))
    assert [r.x for r in df.collect()] == [any(f in (t or "") for f in fragments) for t in texts]
    assert "rlike" not in df._jdf.queryExecution().analyzed().toString().lower()


def test_rows_are_copied_to_a_bounded_number_of_block_pairs(spark):
    rows = spark.range(200).selectExpr("'w' AS g", "id AS k")
    dealt = S.block_pairs(rows, 2)
    assert dealt.groupBy("k").count().agg(F.max("count")).first()[0] == V.BLOCKS
    met = dealt.alias("x").join(dealt.alias("y"), ["g", "i", "j"]).filter("x.k < y.k").select("x.k", "y.k").distinct()
    assert met.count() == 200 * 199 // 2


def test_most_similar_over_tiles():
    x = np.random.default_rng(1).normal(size=(5000, 3))
    for most in (2, 9):
        sims, at = S.most_similar(x[:1500], x, most, False)
        whole = x[:1500] @ x.T
        assert np.allclose(sims, -np.sort(-whole, axis=1)[:, :most]) and np.allclose(np.take_along_axis(whole, at, 1), sims)
    own, _ = S.most_similar(x[:1500], x[:1500], 1, True)
    whole = x[:1500] @ x[:1500].T
    np.fill_diagonal(whole, -np.inf)
    assert np.allclose(own[:, 0], whole.max(axis=1))


def test_pairs_go_to_few_blocks(spark):
    x = np.random.default_rng(2).normal(size=(120, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    found = V.similar_pairs(df, "id", "v", 0.9, block_rows=2)
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, j) for i in range(120) for j in range(i + 1, 120) if x[i] @ x[j] >= 0.9]
    counts = [spark.range(1).select(V.block_count(F.lit(n), 2048).alias("n")).first().n for n in (0, 2048, 2049, 50_000, 200_000, 1_000_000)]
    assert counts == [1, 1, 2, 8, 8, 31]


def test_trees_within_and_between_sides_hold_the_whole_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7:12] = x[6]
    core, order = C.core_distances(x, 3), rng.permutation(50)
    a, b = np.sort(order[:18]), np.sort(order[18:])
    edges = [tuple(e) for e in C.crossing_tree(x[a], x[b], (core[a], core[b]), (a, b))]
    assert len(edges) == 49 and C.crossing_tree(x[a], x[:0], (core[a], core[:0]), (a, a[:0])).shape == (0, 3)
    edges += [(d, s[i], s[j]) for s in (a, b) for d, i, j in C.spanning_tree(x[s], core[s])]
    up, tree = np.arange(50), []
    for _, i, j in sorted(edges):
        i, j = int(i), int(j)
        if up[i] != up[j]:
            up[up == up[i]] = up[j]
            tree.append((i, j))
    assert tree == [(i, j) for _, i, j in sorted(C.spanning_tree(x, core))]
