"""Clustering of unit vectors, by workspace: density, hierarchy, and the policy that picks between them.

Here a workspace is a group of ``applyInPandas`` and must fit into a task; average linkage holds dense n x n distances.
``cluster_scale`` has the same results for larger ones, over many tasks, and sends each workspace where it fits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.config import Settings
from recurq.functions.vectors import as_double, dot, l2_normalize, mean_vectors
from recurq.sources.shared import written


def renumber(labels: np.ndarray) -> np.ndarray:
    """Labels in order of first appearance; noise stays -1."""
    out, seen = np.full(len(labels), -1), {}
    for k, x in enumerate(labels):
        if x >= 0:
            out[k] = seen.setdefault(int(x), len(seen))
    return out


def first_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place reachable from each, over edges between places."""
    parent = np.arange(n)
    while len(a):
        while (parent != parent[parent]).any():
            parent = parent[parent]
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


def dbscan(x: np.ndarray, eps: float, min_samples: int, block: int = 1024) -> np.ndarray:
    """Density clusters by cosine distance. A point counts itself; a border point joins the cluster whose first
    core point comes first."""
    n = len(x)
    edges = []
    for k in range(0, n, block):
        i, j = np.nonzero(x[k : k + block] @ x.T >= 1 - eps - 1e-12)
        edges.append((i + k, j))
    a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, int)
    b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, int)
    core = np.bincount(a, minlength=n) >= min_samples
    both = core[a] & core[b]
    roots = first_roots(n, a[both], b[both])
    labels = np.where(core, roots, -1)
    to_core = core[b] & ~core[a]
    first = np.full(n, n)
    np.minimum.at(first, a[to_core], roots[b[to_core]])
    labels = np.where(~core & (first < n), first, labels)
    # cluster numbers follow the first core point
    order = {r: k for k, r in enumerate(sorted(set(labels[labels >= 0].tolist())))}
    return np.array([order.get(v, -1) for v in labels.tolist()], int)


def agglomerative(x: np.ndarray, threshold: float, min_size: int) -> np.ndarray:
    """Average linkage by cosine distance up to a threshold; smaller clusters are noise."""
    if len(x) < 2:
        return np.full(len(x), -1)
    member = linked_sums(x, np.ones(len(x)), threshold)
    counts = np.bincount(member, minlength=len(x))
    return renumber(np.where(counts[member] >= min_size, member, -1))


def linked_sums(sums: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Average linkage of clusters given as sums of unit vectors and sizes: for each the first it ends up with."""
    n, size = len(sums), size.copy()
    d = np.round(1 - sums @ sums.T / np.outer(size, size), 12)
    np.fill_diagonal(d, np.inf)
    member, alive = np.arange(n), n
    while alive > 1:
        i, j = divmod(int(d.argmin()), n)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = np.round((size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), 12)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive -= 1
        member[member == j] = i
    return member


def core_distances(x: np.ndarray, min_samples: int, block: int = 1024) -> np.ndarray:
    """The distance of the ``min_samples``-th point from each, counted from itself; no more than ``block`` rows of distances are held."""
    k, out = min(min_samples, len(x)) - 1, []
    for lo in range(0, len(x), block):
        d = np.sqrt(np.maximum(0, 2 - 2 * np.round(x[lo : lo + block] @ x.T, 12)))
        d[np.arange(len(d)), lo + np.arange(len(d))] = 0
        out.append(np.partition(d, k, axis=1)[:, k])
    return np.concatenate(out)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """The minimum spanning tree (distance, a < b) of mutual reachability, the only one in the order of those triples."""
    n = len(x)
    best, low, high = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, int)
    open_, places, at, edges = np.ones(n, bool), np.arange(n), 0, []
    for _ in range(n - 1):
        open_[at] = False
        reach = np.maximum(np.maximum(np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ x[at], 12))), core[at]), core)
        a, b = np.minimum(places, at), np.maximum(places, at)
        closer = open_ & ((reach < best) | ((reach == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = reach[closer], a[closer], b[closer]
        left = np.where(open_, best, np.inf)
        ties = np.flatnonzero(left == left.min())
        at = int(ties[np.lexsort((high[ties], low[ties]))[0]])
        edges.append((float(best[at]), int(low[at]), int(high[at])))
    return edges


def crossing_tree(x: np.ndarray, y: np.ndarray, core: tuple[np.ndarray, np.ndarray], place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum spanning tree over the edges between two sides, as rows of ``spanning_tree``; ``place`` orders the rows of both. All distances are held."""
    if not len(x) or not len(y):
        return np.zeros((0, 3))
    d = np.maximum(np.maximum(np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ y.T, 12))), core[0][:, None]), core[1])
    to = (d, np.ascontiguousarray(d.T))
    many = int(max(place[0].max(), place[1].max())) + 1
    open_, best = [np.ones(len(s), bool) for s in place], [np.full(len(s), np.inf) for s in place]
    pair = [np.full(len(s), many * many) for s in place]
    side, at, edges = 0, 0, []
    for _ in range(len(x) + len(y) - 1):
        open_[side][at], best[side][at] = False, np.inf
        other, here = 1 - side, place[side][at]
        reach, code = to[side][at], np.minimum(place[other], here) * many + np.maximum(place[other], here)
        closer = open_[other] & ((reach < best[other]) | ((reach == best[other]) & (code < pair[other])))
        best[other][closer], pair[other][closer] = reach[closer], code[closer]
        low = best[0].min(), best[1].min()
        w, found = min(low), []
        for s in (0, 1):
            if low[s] == w:
                ties = np.flatnonzero(best[s] == w)
                n = ties[pair[s][ties].argmin()]
                found.append((pair[s][n], s, n))
        code, side, at = min(found)
        edges.append((w, *divmod(int(code), many)))
    return np.array(edges)


def condensed(edges: list[tuple[float, int, int]], weight: np.ndarray, fade: np.ndarray, min_cluster: int) -> np.ndarray:
    """Labels by excess of mass from the edges (distance, a, b) of which a spanning tree is the least one.

    A point stands for ``weight`` points that come together at ``fade``. Edges within what is merged are passed over.
    """
    n = len(weight)
    if weight.sum() < max(2, min_cluster):
        return np.full(n, -1)
    # single linkage: nodes n.. are merges
    up, kids, sizes, height = list(range(2 * n)), {}, weight.tolist(), {}

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for w, a, b in sorted(edges):
        a, b, new = top(a), top(b), n + len(kids)
        if a == b:
            continue
        kids[new], height[new] = (a, b), w
        sizes.append(sizes[a] + sizes[b])
        up[a] = up[b] = new

    def leaves(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += kids[u]
        return out

    at = lambda h: 1 / h if h > 0 else 1e12
    # condense: a split counts where both sides are large enough
    root = n + len(kids) - 1 if kids else 0
    birth, stability, parent, split = {root: 0.0}, {}, {}, {}
    stack = [(root, root)]  # (node, the cluster it is in)
    while stack:
        v, cluster = stack.pop()
        stability.setdefault(cluster, 0.0)
        if v < n:  # copies part at last
            if sizes[v] > 1:
                stability[cluster] += sizes[v] * (at(fade[v]) - birth[cluster])
            continue
        lam = at(height[v])
        large = [u for u in kids[v] if sizes[u] >= min_cluster and not (u < n and sizes[u] > 1 and fade[u] >= height[v])]
        stability[cluster] += sum(sizes[u] for u in kids[v] if u not in large) * (lam - birth[cluster])
        if len(large) == 2:
            stability[cluster] += sizes[v] * (lam - birth[cluster])
            split[cluster] = large
            for u in large:
                birth[u], parent[u] = lam, cluster
                stack.append((u, u))
        elif large:
            stack.append((large[0], cluster))
    chosen: set[int] = set()
    for c in sorted(stability, key=lambda c: -birth[c]):
        below = sum(stability[u] for u in split.get(c, []))
        if c == root:
            continue
        if c in split and below > stability[c]:
            stability[c] = below
        else:
            drop = list(split.get(c, []))
            while drop:
                u = drop.pop()
                chosen.discard(u)
                drop += split.get(u, [])
            chosen.add(c)
    labels = np.full(n, -1)
    for k, c in enumerate(chosen):
        labels[leaves(c)] = k
    return renumber(labels)


def hdbscan(x: np.ndarray, min_cluster: int, min_samples: int) -> np.ndarray:
    """Hierarchical density clusters (Campello, Moulavi and Sander 2013), excess of mass, Euclidean distance."""
    n = len(x)
    if n < max(2, min_cluster):
        return np.full(n, -1)
    core = core_distances(x, min_samples)
    return condensed(spanning_tree(x, core), np.ones(n, int), core, min_cluster)


def cluster(x: np.ndarray, s: Settings) -> tuple[np.ndarray, str]:
    """(labels, algorithm) under the policy of the settings."""
    if not len(x):
        return np.zeros(0, int), s.algorithm
    if s.algorithm in ("hdbscan", "auto"):
        labels = hdbscan(x, s.hdbscan_min_cluster, s.hdbscan_min_samples)
        if s.algorithm == "hdbscan" or len(set(labels.tolist()) - {-1}) >= 2:
            return labels, "hdbscan"
    samples = 2 if s.two_example_clusters else s.min_cluster_size
    if s.algorithm == "agglomerative":
        return agglomerative(x, s.eps, samples), "agglomerative"

    def stats(labels: np.ndarray) -> tuple[int, float]:
        counts = np.bincount(labels[labels >= 0])
        return int((counts > 0).sum()), (counts.max() / len(labels) if len(counts) else 0.0)

    labels = dbscan(x, s.eps, samples)
    count, ratio = stats(labels)
    if not count and s.hierarchical_fallback:
        other = agglomerative(x, s.eps, samples)
        if (other >= 0).any():
            return other, "agglomerative"
    if ratio >= 0.35 and len(x) >= 100:
        for step in (0.04, 0.06, 0.08):
            tried = dbscan(x, max(0.18, s.eps - step), samples)
            n, r = stats(tried)
            if n and r < ratio and n >= max(2, count):
                labels, count, ratio = tried, n, r
    return labels, "dbscan"


def cluster_by(df: DataFrame, group: str, key: str, vector: str, s: Settings, run: Callable = cluster) -> DataFrame:
    """(group, key, label, algorithm) of each row; positions follow the key."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", kind="stable")
        labels, algorithm = run(np.stack(part["v"].to_list()), s)
        return pd.DataFrame({"g": part["g"].tolist(), "k": part["k"].tolist(), "label": labels.astype(np.int32), "algorithm": algorithm})

    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), as_double(vector).alias("v"))
    return rows.groupBy("g").applyInPandas(one, f"g {types[group]}, k {types[key]}, label int, algorithm string").withColumnsRenamed({"g": group, "k": key})


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return mean_vectors(df, keys, vector).select(*keys, l2_normalize(F.col("mean")).alias("centroid"))


def support_and_cohesion(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """For each cluster: size, support (mean product with the centroid), the least, and cohesion, their mean."""
    near = df.join(centroids(df, keys, vector), keys).select(*keys, dot(as_double(vector), F.col("centroid")).alias("p"))
    stats = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("p"), 4).alias("support"), F.round(F.min("p"), 4).alias("min_support"))
    return stats.withColumn("cohesion", F.round((F.col("support") + F.col("min_support")) / 2, 4))


def silhouette(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: the mean silhouette by cosine distance without noise, null for one label or none to compare.

    The mean distance of a point to a cluster is 1 - x.sum(cluster)/n, so clusters meet points as sums, one
    row a cluster and place, never as pairs of points.
    """
    points = df.filter(F.col(label) >= 0).select(F.col(label).alias("l"), l2_normalize(as_double(vector)).alias("v")).withColumn("id", F.monotonically_increasing_id())
    points = written(points, "points")
    sums = points.select("l", F.posexplode("v").alias("pos", "x")).groupBy("l", "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"), F.max("n").alias("n"))
    table = sums.agg(F.collect_list(F.struct("l", "total", "n")).alias("clusters"))
    scored = points.crossJoin(F.broadcast(table)).select(
        "l",
        F.transform("clusters", lambda c: F.struct(c["l"].alias("l"), c["n"].alias("n"), dot(F.col("v"), c["total"]).alias("p"))).alias("to"),
    )
    own = F.element_at(F.filter("to", lambda c: c["l"] == F.col("l")), 1)
    others = F.transform(F.filter("to", lambda c: c["l"] != F.col("l")), lambda c: 1 - c["p"] / c["n"])
    scored = scored.withColumn("n", own["n"]).withColumn("a", (own["n"] - own["p"]) / (own["n"] - 1)).withColumn("b", F.array_min(others)).withColumn("k", F.size("to"))
    scored = scored.withColumn("s", F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    out = scored.agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("points"), F.max("k").alias("k"))
    return out.select(F.when((F.col("k") > 1) & (F.col("points") > F.col("k")), F.round("s", 4)).alias("silhouette"))
