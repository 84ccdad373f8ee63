import random

import numpy as np

from recurq.llm import packing


def slow_pack(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(room, b) for b, (room, ss, cc) in enumerate(bins) if room >= size and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fits:
            least = min(r for r, _ in fits)
            out.append((least, s, c, size))
            b = next(b for r, b in fits if r == least)
        else:
            out.append((capacity, s, c, size))
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        bins[b][0] -= size
        bins[b][1].add(s) if s >= 0 else None
        bins[b][2].add(c) if c >= 0 else None
    return out, len(bins)


def test_every_piece_takes_the_tightest_room():
    rng = random.Random(2)
    for many in (5, 200):
        n = 400
        sizes = np.array(sorted((rng.randint(1, 50) for _ in range(n)), reverse=True))
        sources = np.array([rng.choice([0, 0, rng.randint(-1, many)]) for _ in range(n)])
        clusters = np.array([rng.randint(-1, many) if rng.random() < 0.3 else -1 for _ in range(n)])
        bins, offsets = packing.pack(sizes, sources, clusters, 100)
        left, held = {}, {}
        for k in range(n):  # the room a piece found is the least that any compatible bin had
            s, c, b = sources[k], clusters[k], bins[k]
            fits = [left[x] for x in left if left[x] >= sizes[k] and (s < 0 or s not in held[x][0]) and (c < 0 or c not in held[x][1])]
            assert (left[b] == min(fits)) if fits else b not in left
            left.setdefault(b, 100)
            held.setdefault(b, (set(), set()))
            assert offsets[k] == 100 - left[b]
            left[b] -= sizes[k]
            held[b][0].add(s)
            held[b][1].add(c)


def test_packs_every_piece_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None), (7001, "", "a", 1), (7002, "é" * 20000, None, 1), (7002, "é" * 20000, None, 1)], "doc_id long, text string, source string, bin int")
    df = df.select("doc_id", "text", "source").withColumn("bin", df.doc_id.cast("int")).unionByName(extra)
    got = packing.best_fit(df, capacity=4096, block_rows=100).toPandas()
    texts = df.toPandas()
    want = sum(max(1, -(-len(t or "") // 4095)) for t in texts["text"])
    assert len(got) == want
    assert got["size"].sum() == sum(len(t or "") for t in texts["text"]) + want
    fill = got.groupby("bin").agg({"size": "sum", "offset": "max"})
    assert fill["size"].max() <= 4096
    for _, rows in got.groupby("bin"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["size"].cumsum().tolist()[:-1]]
    source = dict(zip(texts["doc_id"], texts["source"], strict=True))
    text = dict(zip(texts["doc_id"], texts["text"], strict=True))
    for _, rows in got.groupby("bin"):
        s = [source[d] for d in rows["doc_id"] if d == d and source[d]]
        assert len(s) == len(set(s))
        t = [text[d] for d in rows["doc_id"] if d == d]
        assert len(t) == len(set(t))


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
