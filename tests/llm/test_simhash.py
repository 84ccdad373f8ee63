import numpy as np
import xxhash

from recurq.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    for text in ["", None, "  ", "One", "a b c d", "a b c d E f\tg\x0bh", "é É x y z " * 20]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        assert simhash.fingerprint(text, run=3) == brute_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_link_blocks_finds_every_component():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 15, dtype=np.uint64)
    x = [base]
    for _ in range(12):
        y = base.copy()
        for _ in range(rng.integers(1, 5)):
            y ^= np.uint64(1) << rng.integers(0, 64, 15).astype(np.uint64)
        x.append(y)
    x = np.unique(np.concatenate(x))
    x = x[np.argsort(simhash.gray_rank(x))]
    want = brute_components([int(v) for v in x], range(len(x)))
    half = len(x) // 2
    forest = simhash.Forest(len(x))
    for left, right, at in ((x[:half], None, 0), (x[half:], None, half), (x[:half], x[half:], 0)):
        a, b = simhash.link_blocks(left, right, 4)
        forest.union(a + at, b + at)
    assert forest.roots().tolist() == want


def test_near_duplicates_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, rows[3][1]), (10**6, None), (10**6 + 1, " "), (10**6 + 2, rows[0][1] + " tail"), (rows[5][0], rows[5][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, least_blocks=3).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps, [i for i, _ in rows])
    assert got == sorted((str(i), f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_several_blocks_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000 + k, f"{rows[k][1]} tail{k}") for k in range(60)] + [(9000, None), (9001, ""), (9002, " ")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, fp int"), block_rows=40).collect()
    want = brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    assert {r.doc_id: r.component_id for r in got} == dict(zip([i for i, _ in rows], want, strict=True))


def test_a_bridge_larger_than_both_of_its_ends_over_several_blocks(spark):
    """Two fingerprints 8 bits apart hang together on one between them that is larger than either."""
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 62, 3000)
    y = (0x7FFF << 48) | (int(rng.integers(0, 1 << 40)) << 8)
    x = y | 0b11110000
    z = x & ~(0b1111 << 56)
    fps = [*map(int, fps), y, z, x]
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = simhash.hamming_components(table, block_rows=400).collect()
    assert len(got) == len({r.vertex for r in got})
    of = {r.vertex: r.component for r in got}
    assert of[x] == of[y] == of[z] == min(x, y, z)
