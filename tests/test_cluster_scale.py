"""Clustering over many tasks against the functions that take a workspace as one matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.operators import cluster as C
from recurq.operators import cluster_scale as S
from recurq.operators.components import connected_components


def workspaces(seed=0, sizes=(90, 40, 12, 1), dim=6, copies=True):
    """{workspace: {key: unit vector}}: blobs of different spread, noise, copies and a zero vector."""
    rng, out, key = np.random.default_rng(seed), {}, 0
    for w, n in enumerate(sizes):
        centres = rng.normal(size=(4, dim))
        x = np.vstack([centres[rng.integers(4)] + rng.normal(size=dim) * rng.choice([0.1, 0.3, 1.5]) for _ in range(n)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if copies and n > 20:
            x[5:11], x[20] = x[4], 0
        keys = rng.permutation(n) + key
        key += n
        out[w] = {int(k): v for k, v in sorted(zip(keys, x, strict=True), key=lambda p: p[0])}
    return out


def table(spark, of):
    return spark.createDataFrame([(w, k, v.tolist()) for w, rows in of.items() for k, v in rows.items()], "w int, k long, v array<double>").repartition(5)


def partition(labels):
    """Labels as the sets of their keys, noise apart."""
    sets = {}
    for k, c in labels.items():
        if c is not None and c != -1:
            sets.setdefault(c, set()).add(k)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("min_samples", [2, 3, 5])
def test_density_equals_one_matrix(spark, min_samples):
    of = workspaces(min_samples)
    df = table(spark, of)
    got = S.numbered(S.density(df, "w", "k", "v", 0.12, min_samples, block_rows=16), df, "w", "k")
    got = {r.k: r.label for r in got.collect()}
    want = {}
    for rows in of.values():
        want |= dict(zip(rows, C.dbscan(np.stack(list(rows.values())), 0.12, min_samples).tolist(), strict=True))
    assert got == want and len(set(want.values())) > 3


@pytest.mark.parametrize(("min_cluster", "min_samples", "task_edges"), [(3, 2, 2_000_000), (5, 4, 2_000_000), (3, 3, 30)])
def test_hierarchy_equals_one_matrix(spark, min_cluster, min_samples, task_edges):
    of = workspaces(min_cluster + min_samples)
    got = {r.k: r.label for r in S.density_hierarchy(table(spark, of), "w", "k", "v", min_cluster, min_samples, block_rows=16, task_edges=task_edges).collect()}
    want = {}
    for rows in of.values():
        want |= dict(zip(rows, C.hdbscan(np.stack(list(rows.values())), min_cluster, min_samples).tolist(), strict=True))
    assert set(got) == set(want)
    for rows in of.values():
        assert partition({k: got[k] for k in rows}) == partition({k: want[k] for k in rows})
    assert len(set(want.values())) > 2


@pytest.mark.parametrize("task_rows", [5, 2000])
def test_average_linkage_equals_one_matrix(spark, task_rows):
    of = workspaces(11)
    df = table(spark, of)
    got = {r.k: r.label for r in S.numbered(S.average_linkage(df, "w", "k", "v", 0.3, 2, block_rows=16, task_rows=task_rows), df, "w", "k").collect()}
    want = {}
    for rows in of.values():
        want |= dict(zip(rows, C.agglomerative(np.stack(list(rows.values())), 0.3, 2).tolist(), strict=True))
    assert got == want and len(set(want.values())) > 3


def test_one_matrix_equals_plain_loops():
    x = np.stack(list(workspaces(3, sizes=(40,), copies=False)[0].values()))
    d = 1 - x @ x.T
    clusters = [[k] for k in range(len(x))]
    while len(clusters) > 1:
        best = min((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > 0.3:
            break
        clusters[best[1]] += clusters.pop(best[2])
    want = sorted(sorted(c) for c in clusters if len(c) > 1)
    assert partition(dict(enumerate(C.agglomerative(x, 0.3, 2).tolist()))) == want
    # the spanning tree by Kruskal over all pairs
    core = C.core_distances(x, 3)
    e = np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ x.T, 12)))
    assert np.allclose(core, np.sort(np.where(np.eye(len(x), dtype=bool), 0, e), axis=1)[:, 2])
    reach, up, tree = np.maximum(np.maximum(e, core[:, None]), core), list(range(len(x))), []
    for w, a, b in sorted((reach[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):
        ra, rb = a, b
        while up[ra] != ra:
            ra = up[ra]
        while up[rb] != rb:
            rb = up[rb]
        if ra != rb:
            up[ra] = rb
            tree.append((w, a, b))
    assert sorted(C.spanning_tree(x, core)) == tree


@pytest.mark.parametrize("settings", [Settings(), Settings(algorithm="dbscan", eps=0.12), Settings(algorithm="dbscan", eps=0.5, two_example_clusters=False), Settings(algorithm="agglomerative", eps=0.3), Settings(algorithm="hdbscan"), Settings(algorithm="dbscan", eps=1e-9)], ids=range(6))
def test_workspaces_go_where_they_fit(spark, settings):
    of = workspaces(4, sizes=(130, 30, 8))
    got = {r.k: (r.label, r.algorithm) for r in S.cluster_workspaces(table(spark, of), "w", "k", "v", settings, task_rows=20, block_rows=64).collect()}
    for rows in of.values():
        labels, algorithm = C.cluster(np.stack(list(rows.values())), settings)
        assert {got[k][1] for k in rows} == {algorithm}
        assert partition({k: got[k][0] for k in rows}) == partition(dict(zip(rows, labels.tolist(), strict=True)))


def test_empty_tables(spark):
    df = table(spark, workspaces(1)).limit(0)
    assert S.density(df, "w", "k", "v", 0.1, 3).collect() == []
    assert S.density_hierarchy(df, "w", "k", "v", 3, 2).collect() == []
    assert S.average_linkage(df, "w", "k", "v", 0.3, 2).collect() == []
    assert S.cluster_workspaces(df, "w", "k", "v", Settings()).collect() == []


def union_find(edges):
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    return {x: top(x) for x in up}


def test_components_of_many_small_graphs(spark):
    rng, edges = np.random.default_rng(7), [(3, 1), (3, 2), (1010, 1005), (1010, 1001), (1011, 1005), (1011, 1002)]
    for g in range(2, 500):
        n = int(rng.integers(6, 31))
        edges += [(1000 * g + int(a), 1000 * g + int(b)) for a, b in rng.integers(0, n, (int(rng.integers(1, n + 1)), 2)) if a != b]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.vertex for r in got})
    assert {r.vertex: r.component for r in got} == union_find(edges)
    alone = connected_components(spark.createDataFrame([(3, 1), (3, 2)], "u long, v long")).orderBy(F.col("vertex")).collect()
    assert [tuple(r) for r in alone] == [(1, 1), (2, 1), (3, 1)]
