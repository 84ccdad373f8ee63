import hashlib
import random
import zlib

import pytest

from recurq.llm import periodic_runs as P
from recurq.llm import queries


def brute(words, least_length=6, least_periods=4):
    """Runs by trying every period at every place."""
    n, out = len(words), []
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            part = words[i : j + p]
            if len(part) >= max(least_length, least_periods * p) and not any(part[: len(part) - q] == part[q:] for q in range(1, p)):
                out.append((i, len(part), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, letters):
    out = []
    for _ in range(rng.randint(0, 6)):
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(300):
        w = repetitive(rng, letters)
        assert P.runs(w) == brute(w), w
        assert P.text_runs([b"w%d" % x for x in w]) == brute(w)
        assert P.runs(w, 3, 3) == brute(w, 3, 3)


def test_long_runs_nested_runs_and_hash_free_strings():
    assert P.runs([0] * 5000) == [(0, 5000, 1)]
    inner = [0, 0, 0, 0, 0, 0, 1]
    assert P.runs(inner * 4) == brute(inner * 4)
    fib = [[0], [0, 1]]
    thue = [0]
    for _ in range(9):
        fib.append(fib[-1] + fib[-2])
        thue += [1 - x for x in thue]
    assert P.runs(fib[-1]) == brute(fib[-1]) and P.runs(thue) == []


def test_collapsed():
    assert P.collapsed(b"a b a b a b a b c".split(), [(0, 8, 2)]) == b"a b c"
    assert P.collapsed([], []) == b""


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_of_whole_documents(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got, many = queries.op12_periodic_runs(spark, sf_dir).collect(), 0
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        words = planted(r.doc_id, docs[r.doc_id].encode().split())
        if len(words) > 1500:
            continue
        want = brute(words)
        many += len(want)
        s, length, p = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(want), s, length, p, 1000 * length // p if want else None)
        drop = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
    assert many


def test_odd_tables(spark):
    rows = [(None, None, "a"), (1, "", "b"), (2, " \t\n\x0b\x0c\r ", "c"), (2, "é\x1c " * 6, "d"), (2, "é\x1c " * 6, "d"), (3, "la la-la " * 40_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(df, block_bytes=10).collect()]
    assert sorted(got, key=str) == sorted([(None, [], ""), (1, [], ""), (2, [], ""), (2, [(0, 6, 1)], "é\x1c"), (2, [(0, 6, 1)], "é\x1c"), (3, [(0, 80_000, 2)], "la la-la")], key=str)
    assert P.periodic_runs(df.limit(0)).collect() == []
    from pyspark.sql import functions as F

    all_ids = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 40), lambda x: x), "\t")).alias("text"))
    for r in all_ids.unionByName(spark.createDataFrame([(10, ""), (30, None), (None, "a b")], "doc_id long, text string")).select("doc_id", "text", P.with_planted_periods(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("t")).collect():
        words = (r.text or "").split()
        assert r.t.split() == (planted(r.doc_id, words) if r.doc_id is not None else words)
