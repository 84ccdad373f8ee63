"""Clustering of a workspace over many tasks: density, density hierarchy and average linkage, as blocks of products.

Equal vectors are one row with a weight first, so copies are never expanded into pairs. The rows of a workspace are
dealt to blocks, and each task multiplies the vectors of two blocks tile by tile: it holds two blocks, whatever the size of the
workspace, and one tile of products, and returns a bounded number of rows for each row it has (counts, nearest sides, a spanning forest), never all
similar pairs. Results equal those of the functions in ``cluster`` that take one workspace as a matrix.

* Density: core counts; a spanning forest of core rows for each pair of blocks and connected components over all
  forests; a border row joins the cluster whose first core row comes first.
* Density hierarchy: a minimum spanning tree within each block and one between the sides of each pair, whose union has that of the workspace; Borůvka
  rounds shrink the union until a workspace's edges fit ``task_edges``; then the edges, three numbers each, are sorted and
  merged to the condensed tree. That last step takes one task a workspace, linear in its distinct vectors.
* Average linkage: on unit vectors the mean distance of two clusters is 1 - S.T / (m n) of their sums, so a cluster is
  its sum and size. Each round merges all pairs that are nearest to each other; a cluster without another
  below the threshold is finished, as no later merge can come nearer. What ``task_rows`` bounds is finished in one task.

Keys are unique over all workspaces and can be ordered. Cases: zero vectors are never copies of each other; a null
workspace is one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.config import Settings
from recurq.functions.vectors import as_double, block_count, dot, tiles
from recurq.operators.cluster import cluster_by, condensed, crossing_tree, first_roots, linked_sums, spanning_tree
from recurq.operators.components import connected_components
from recurq.sources.shared import maybe_broadcast, written

#: Rows that a block of a workspace has at least, where there are several: a task holds two.
BLOCK_ROWS = 2048


def _plain(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(g, k, v, h): workspace, key, vector, and a number that equal vectors of a length near one share."""
    v = as_double(vector)
    rows = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(key).alias("k"), v.alias("v"))
    return rows.withColumn("h", F.when(dot(F.col("v"), F.col("v")) < 0.5, F.xxhash64("k", "g")).otherwise(F.xxhash64("v")))


def _classes(rows: DataFrame, name: str) -> DataFrame:
    """One row for each distinct vector of a workspace: the least key and how many rows it stands for."""
    return written(rows.groupBy("g", "h", "v").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("w")), name)


def block_pairs(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` (g, k, ...) dealt to blocks of their workspace, once for each pair of blocks (i <= j) that they are in."""
    blocks = maybe_broadcast(written(rows.groupBy("g").agg(block_count(F.count(F.lit(1)), block_rows).alias("n")), "blocks"))
    dealt = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return sides.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")


def _sides(part: pd.DataFrame) -> tuple[bool, pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """Whether the block meets itself, both sides in the order of their keys, and their vectors."""
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    part = part.sort_values("k", kind="stable", ignore_index=True)
    left = part[part["own"] == i]
    right = left if i == j else part[part["own"] == j]
    x = np.stack(left["v"].to_list()) if len(left) else np.zeros((0, 0))
    y = x if i == j else np.stack(right["v"].to_list()) if len(right) else np.zeros((0, 0))
    return i == j, left, right, x, y


def _frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) if isinstance(v, list) else v for k, v in columns.items()})


def density(df: DataFrame, group: str, key: str, vector: str, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, component): the least core key of the row's cluster, null for noise. A row counts itself."""
    kind = df.schema[key].dataType.simpleString()
    rows = written(_plain(df, group, key, vector), "plain")
    classes = _classes(rows, "classes")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        out, wide = {"k": left["k"].tolist()}, (left["w"].to_numpy(), right["w"].to_numpy())
        c, d, selves = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.zeros(len(x), bool)
        for a, b, sims in tiles(x, y):
            i, j = np.nonzero(sims >= 1 - eps - 1e-12)
            i, j = i + a, j + b
            c += np.bincount(i, wide[1][j], len(c)).astype(np.int64)
            if own:
                selves[i[i == j]] = True
            else:
                d += np.bincount(j, wide[0][i], len(d)).astype(np.int64)
        if own:  # a row counts itself, a zero vector's too
            return _frame({"k": out["k"], "c": c + ~selves})
        return _frame({"k": out["k"] + right["k"].tolist(), "c": np.concatenate((c, d))})

    counts = block_pairs(classes, block_rows).groupBy("g", "i", "j").applyInPandas(count, f"k {kind}, c long").groupBy("k").agg(F.sum("c").alias("c"))
    known = written(classes.join(counts, "k").withColumn("core", F.col("c") >= min_samples).drop("c"), "core")

    def forest(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        keys = left["k"].tolist() + ([] if own else right["k"].tolist())
        ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
        for a, b, sims in tiles(x, y):
            i, j = np.nonzero(sims >= 1 - eps - 1e-12)
            j += len(sims)
            if len(i) > sum(sims.shape):  # the tile's own forest is enough
                roots = first_roots(sum(sims.shape), i, j)
                j = np.flatnonzero(roots != np.arange(len(roots)))
                i = roots[j]
            place = np.concatenate((np.arange(a, a + len(sims)), np.arange(b, b + sims.shape[1]) + (0 if own else len(x))))
            ends.append((place[i], place[j]))
        roots = first_roots(len(keys), *map(np.concatenate, zip(*ends, strict=True)))
        hung = np.flatnonzero(roots != np.arange(len(keys)))
        return _frame({"a": [keys[x] for x in roots[hung]], "b": [keys[x] for x in hung]})

    core = known.filter("core").select("g", "k", "v")
    edges = written(block_pairs(core, block_rows).groupBy("g", "i", "j").applyInPandas(forest, f"a {kind}, b {kind}"), "forests")
    linked = connected_components(edges, "a", "b")
    cores = core.select("k").join(linked.withColumnRenamed("vertex", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    marked = written(known.join(cores, "k", "left"), "marked")

    def border(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        found: dict = {}
        for here, there, ours, theirs in ((left, right, x, y), (right, left, y, x))[: 1 if own else 2]:
            out, to = ~here["core"].to_numpy(bool), there["core"].to_numpy(bool)
            if not out.any() or not to.any():
                continue
            names, number = np.unique(there["component"][to].to_numpy(), return_inverse=True)
            least = np.full(int(out.sum()), len(names))
            for a, b, sims in tiles(ours[out], theirs[to]):
                i, j = np.nonzero(sims >= 1 - eps - 1e-12)
                np.minimum.at(least, i + a, number[j + b])
            found |= {k: names[n] for k, n in zip(here["k"][out], least, strict=True) if n < len(names)}
        return _frame({"k": list(found), "component": list(found.values())})

    joined = block_pairs(marked.select("g", "k", "v", "core", F.coalesce("component", "k").alias("component")), block_rows).groupBy("g", "i", "j").applyInPandas(border, f"k {kind}, component {kind}")
    joined = joined.groupBy("k").agg(F.min("component").alias("joined"))
    labels = written(marked.join(joined, "k", "left").select("g", "h", "v", F.coalesce("component", "joined").alias("component")), "density")
    return rows.join(labels, ["g", "h", "v"]).select(F.col("k").alias(key), "component")


def numbered(found: DataFrame, df: DataFrame, group: str, key: str) -> DataFrame:
    """(key, label): components numbered from 0 in each workspace in order; rows without one have -1."""
    of = found.filter("component IS NOT NULL").join(df.select(key, group), key).select(group, "component").distinct()
    label = of.withColumn("label", F.row_number().over(Window.partitionBy(group).orderBy("component")) - 1).select("component", "label")
    return found.join(label, "component", "left").select(key, F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def most_similar(x: np.ndarray, y: np.ndarray, most: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its ``most`` largest products and which rows of ``y`` they are with, not itself if ``own``; -inf where there are fewer."""
    best, at = np.full((len(x), most), -np.inf), np.zeros((len(x), most), int)
    for a, b, sims in tiles(x, y):
        rows = np.arange(len(sims))[:, None]
        if own:
            same = np.arange(max(a, b), max(a, b, min(a + sims.shape[0], b + sims.shape[1])))
            sims[same - a, same - b] = -np.inf
        if most <= 8:
            found = np.zeros((len(sims), min(most, sims.shape[1])), int)
            values = np.zeros(found.shape)
            for k in range(found.shape[1]):
                found[:, k] = sims.argmax(axis=1)
                values[:, k] = sims[rows[:, 0], found[:, k]]
                sims[rows[:, 0], found[:, k]] = -np.inf
        else:
            k = min(most, sims.shape[1])
            found = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            values = sims[rows, found]
        values, found = np.hstack((best[a : a + len(sims)], values)), np.hstack((at[a : a + len(sims)], found + b))
        order = np.argsort(-values, axis=1, kind="stable")[:, :most]
        best[a : a + len(sims)], at[a : a + len(sims)] = values[rows, order], found[rows, order]
    return best, at


def _mutual(classes: DataFrame, kind: str, min_samples: int, block_rows: int) -> DataFrame:
    """``classes`` with ``core``, the distance of the ``min_samples``-th row counted from the row itself, and ``fade``,
    the height at which the copies of the row come together."""

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for here, there, ours, theirs in ((left, right, x, y), (right, left, y, x))[: 1 if own else 2]:
            sims, at = most_similar(ours, theirs, min_samples, own)
            known = np.isfinite(sims)
            d = np.sqrt(np.maximum(0, 2 - 2 * np.round(sims[known], 12)))
            out.append((np.repeat(here["k"].to_numpy(), known.sum(axis=1)), d, there["w"].to_numpy()[at[known]]))
        k, d, w = map(np.concatenate, zip(*out, strict=True))
        return _frame({"k": k.tolist(), "d": d, "w": w.astype(np.int64)})

    sides = block_pairs(classes, block_rows).groupBy("g", "i", "j").applyInPandas(nearest, f"k {kind}, d double, w long")
    # the row itself is at distance 0, its copies as far as its length makes them
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.round(dot(F.col("v"), F.col("v")), 12)))
    selves = classes.select("k", F.lit(0.0).alias("d"), F.lit(1).cast("long").alias("w")).unionAll(classes.filter("w > 1").select("k", apart, F.col("w") - 1))
    near = sides.unionByName(selves).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "w"))).alias("near"))
    # the first distance at which the weights reach min_samples, else the last
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    step = lambda s, x: F.when(s["n"] >= min_samples, s).otherwise(F.struct((s["n"] + x["w"]).alias("n"), x["d"].alias("d")))
    core = near.select("k", F.aggregate("near", start, step)["d"].alias("core"))
    return classes.join(core, "k").withColumn("fade", F.when(F.col("w") > 1, F.greatest("core", apart)).otherwise(F.col("core")))


def _shrunk(edges: DataFrame, kind: str, task_edges: int) -> DataFrame:
    """Edges (g, a, b, d) of which the minimum spanning tree of each workspace is left, those of small workspaces as they are.

    A Borůvka round takes each component's least edge, joins components over them and drops what lies within one.
    """
    done: list[DataFrame] = []
    open_ = edges.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    while True:
        sizes = written(open_.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
        large = maybe_broadcast(sizes.filter(F.col("n") > task_edges).select("g"))
        done.append(open_.join(large, "g", "left_anti").select("g", "a", "b", "d", "ca", "cb"))
        open_ = written(open_.join(large, "g", "left_semi"), "open")
        if not open_.take(1):
            break
        order = F.struct("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "ca", "cb")
        both = open_.select("g", F.col("ca").alias("c"), order.alias("e")).unionAll(open_.select("g", F.col("cb"), order))
        least = written(both.groupBy("g", "c").agg(F.min("e").alias("e")).select("g", F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.col("e.d").alias("d"), F.col("e.ca").alias("ca"), F.col("e.cb").alias("cb")).distinct(), "least")
        done.append(least)  # edges of the tree
        to = written(connected_components(least, "ca", "cb"), "joined")
        for side in ("ca", "cb"):
            of = maybe_broadcast(to.select(F.col("vertex").alias(side), F.col("component").alias("to")))
            open_ = open_.join(of, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        open_ = written(open_.filter("ca <> cb"), "outer")
    return reduce(DataFrame.unionByName, done).select("g", "a", "b", "d")


def density_hierarchy(df: DataFrame, group: str, key: str, vector: str, min_cluster: int, min_samples: int, block_rows: int = BLOCK_ROWS, task_edges: int = 2_000_000) -> DataFrame:
    """(key, label) as ``cluster.hdbscan`` gives them for each workspace."""
    kind = df.schema[key].dataType.simpleString()
    rows = written(_plain(df, group, key, vector), "plain")
    classes = written(_mutual(_classes(rows, "classes"), kind, min_samples, block_rows), "mutual")

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        keys, core = part["k"].sort_values(kind="stable").to_numpy(), (left["core"].to_numpy(), right["core"].to_numpy())
        at, found = (left.index.to_numpy(), right.index.to_numpy()), [np.zeros((0, 3))]
        # the edges of all rows are those within small blocks and those between two, so the trees of both have all that is needed
        for a in range(0, len(x), block_rows):
            ours = slice(a, a + block_rows)
            if own:
                found.append(np.array(spanning_tree(x[ours], core[0][ours])).reshape(-1, 3) + [0, a, a])
            for b in range(a + block_rows if own else 0, len(y), block_rows):
                theirs = slice(b, b + block_rows)
                found.append(crossing_tree(x[ours], y[theirs], (core[0][ours], core[1][theirs]), (at[0][ours], at[1][theirs])))
        d, a, b = np.concatenate(found).T
        return _frame({"g": [part["g"].iloc[0]] * len(d), "a": keys[a.astype(int)].tolist(), "b": keys[b.astype(int)].tolist(), "d": d})

    pairs = block_pairs(classes.select("g", "k", "v", "core"), block_rows)
    trees = pairs.groupBy("g", "i", "j").applyInPandas(tree, f"g string, a {kind}, b {kind}, d double")
    edges = _shrunk(written(trees, "trees"), kind, task_edges)
    # points are rows, too: with themselves as the other end
    points = classes.select("g", F.col("k").alias("a"), F.col("k").alias("b"), F.col("fade").alias("d"), "w")

    def labels(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["w"] > 0].sort_values("a", kind="stable")
        number = {k: n for n, k in enumerate(own["a"].tolist())}
        other = part[part["w"] == 0]
        merges = list(zip(other["d"].tolist(), map(number.__getitem__, other["a"].tolist()), map(number.__getitem__, other["b"].tolist()), strict=True))
        found = condensed(merges, own["w"].to_numpy(), own["d"].to_numpy(), min_cluster)
        return _frame({"k": own["a"].tolist(), "label": found.astype(np.int32)})

    both = points.unionByName(edges.withColumn("w", F.lit(0).cast("long")))
    found = both.groupBy("g").applyInPandas(labels, f"k {kind}, label int")
    of = written(classes.select("g", "h", "v", "k").join(found, "k").drop("k"), "hierarchy")
    return rows.join(of, ["g", "h", "v"]).select(F.col("k").alias(key), "label")


def average_linkage(df: DataFrame, group: str, key: str, vector: str, threshold: float, min_size: int, block_rows: int = BLOCK_ROWS, task_rows: int = 2000) -> DataFrame:
    """(key, component): the least key of the row's cluster, null for clusters below ``min_size``."""
    kind = df.schema[key].dataType.simpleString()
    rows = written(_plain(df, group, key, vector), "plain")
    classes = _classes(rows, "classes")
    merges: list[DataFrame] = []
    open_ = classes.select("g", "k", F.transform("v", lambda x: x * F.col("w")).alias("s"), "w")

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        own, left, right, x, y = _sides(part)
        best, at = (np.full(len(x), np.inf), np.full(len(y), np.inf)), (np.zeros(len(x), int), np.zeros(len(y), int))
        for a, b, sims in tiles(x, y):
            d = np.round(1 - sims, 12)
            if own:
                same = np.arange(max(a, b), max(a, b, min(a + d.shape[0], b + d.shape[1])))
                d[same - a, same - b] = np.inf
            # equal distances: the least key, which comes first, makes the least pair of keys
            for side, axis, to, of in ((0, 1, a, b), (1, 0, b, a))[: 1 if own else 2]:
                first = d.argmin(axis=axis)
                value, rows = np.take_along_axis(d, np.expand_dims(first, axis), axis).ravel(), slice(to, to + d.shape[side])
                less = value < best[side][rows]
                best[side][rows] = np.where(less, value, best[side][rows])
                at[side][rows] = np.where(less, first + of, at[side][rows])
        out = []
        for here, there, value, which in ((left, right, best[0], at[0]), (right, left, best[1], at[1]))[: 1 if own else 2]:
            keys, others = here["k"].tolist(), there["k"].tolist()
            out += [(keys[n], float(value[n]), *sorted((keys[n], others[which[n]]))) for n in np.flatnonzero(value <= threshold)]
        return _frame({"k": [o[0] for o in out], "d": np.array([o[1] for o in out], float), "a": [o[2] for o in out], "b": [o[3] for o in out]})

    def rest(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", kind="stable")
        keys = part["k"].tolist()
        to = linked_sums(np.stack(part["s"].to_list()), part["w"].to_numpy(float), threshold)
        hung = np.flatnonzero(to != np.arange(len(to)))
        return _frame({"a": [keys[x] for x in to[hung]], "b": [keys[x] for x in hung]})

    while True:
        sizes = written(open_.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
        large = maybe_broadcast(sizes.filter(F.col("n") > task_rows).select("g"))
        small = open_.join(large, "g", "left_anti")
        merges.append(written(small.groupBy("g").applyInPandas(rest, f"a {kind}, b {kind}"), "merges"))
        open_ = written(open_.join(large, "g", "left_semi"), "open")
        if not open_.take(1):
            break
        means = open_.select("g", "k", F.transform("s", lambda x: x / F.col("w")).alias("v"))
        found = block_pairs(means, block_rows).groupBy("g", "i", "j").applyInPandas(nearest, f"k {kind}, d double, a {kind}, b {kind}")
        best = written(found.groupBy("k").agg(F.min(F.struct("d", "a", "b")).alias("e")), "nearest")
        # both ends chose the pair
        chosen = written(best.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b"), "merges")
        merges.append(chosen)
        # what has no other below the threshold is finished
        near = open_.join(maybe_broadcast(best.select("k")), "k", "left_semi")
        ends = written(chosen.select(F.col("b").alias("k"), F.col("a").alias("to")).unionAll(chosen.select(F.col("a").alias("k"), F.col("a").alias("to"))), "ends")
        moved = near.join(maybe_broadcast(ends), "k", "left")
        # two of each, as both ends chose the other
        two = moved.filter("to IS NOT NULL").groupBy("g", F.col("to").alias("k")).agg(F.collect_list(F.struct("s", "w")).alias("p"))
        met = two.select("g", "k", F.zip_with(F.col("p")[0]["s"], F.col("p")[1]["s"], lambda x, y: x + y).alias("s"), (F.col("p")[0]["w"] + F.col("p")[1]["w"]).alias("w"))
        open_ = written(moved.filter("to IS NULL").select("g", "k", "s", "w").unionByName(met), "sums")
    linked = connected_components(written(reduce(DataFrame.unionByName, merges), "links"), "a", "b")
    named = classes.join(linked.withColumnRenamed("vertex", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    counts = named.groupBy("component").agg(F.sum("w").alias("size"))
    kept = named.join(counts, "component").select("g", "h", "v", F.when(F.col("size") >= min_size, F.col("component")).alias("component"))
    return rows.join(written(kept, "linkage"), ["g", "h", "v"]).select(F.col("k").alias(key), "component")


def cluster_workspaces(df: DataFrame, group: str, key: str, vector: str, s: Settings, task_rows: int = 4000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, label, algorithm) of each row under the policy of the settings.

    Workspaces of up to ``task_rows`` rows are clustered in a task each, larger ones over many tasks; sizes come from a
    count. The policy, ``cluster.cluster``, is followed by workspace: what it looks at are counts of clusters and rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(key).alias("k"), as_double(vector).alias("v"))
    sizes = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.filter(F.col("n") > task_rows).select("g")
    at_once = cluster_by(rows.join(maybe_broadcast(large), "g", "left_anti"), "g", "k", "v", s).select("k", "label", "algorithm")
    if large.take(1):
        at_once = at_once.unionByName(_by_policy(written(rows.join(maybe_broadcast(large), "g", "left_semi"), "large"), kind, s, block_rows))
    return at_once.withColumnRenamed("k", key)


def _by_policy(rows: DataFrame, kind: str, s: Settings, block_rows: int) -> DataFrame:
    """(k, label, algorithm) of ``rows`` (g, k, v) whose workspaces are all large."""
    done: list[DataFrame] = []
    open_ = rows
    samples = 2 if s.two_example_clusters else s.min_cluster_size

    def settled(labels: DataFrame, algorithm: str, which: DataFrame | None) -> None:
        """Take the labels of the workspaces in ``which``, or of all that are open."""
        nonlocal open_
        part = open_ if which is None else open_.join(maybe_broadcast(which), "g", "left_semi")
        done.append(labels.join(part.select("k"), "k", "left_semi").select("k", "label", F.lit(algorithm).alias("algorithm")))
        open_ = open_.limit(0) if which is None else open_.join(maybe_broadcast(which), "g", "left_anti")

    def of(found: DataFrame) -> DataFrame:
        return written(numbered(found, rows, "g", "k"), "labels")

    def counted(labels: DataFrame) -> DataFrame:
        """(g, clusters, ratio) of the open workspaces: how many clusters, and the share of rows in the largest."""
        by = open_.select("g", "k").join(labels, "k").groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
        whole = by.groupBy("g").agg(F.sum("n").alias("rows"), F.count_if(F.col("label") >= 0).alias("clusters"), F.max(F.when(F.col("label") >= 0, F.col("n")).otherwise(0)).alias("most"))
        return written(whole.select("g", "rows", "clusters", (F.col("most") / F.col("rows")).alias("ratio")), "counted")

    if s.algorithm in ("hdbscan", "auto"):
        labels = written(density_hierarchy(rows, "g", "k", "v", s.hdbscan_min_cluster, s.hdbscan_min_samples, block_rows), "labels")
        settled(labels, "hdbscan", None if s.algorithm == "hdbscan" else counted(labels).filter("clusters >= 2").select("g"))
    elif s.algorithm == "agglomerative":
        settled(of(average_linkage(rows, "g", "k", "v", s.eps, samples, block_rows)), "agglomerative", None)
    if open_.take(1):
        labels = of(density(open_, "g", "k", "v", s.eps, samples, block_rows))
        first = counted(labels)
        none = first.filter("clusters = 0").select("g")
        if s.hierarchical_fallback and none.take(1):
            other = of(average_linkage(open_.join(maybe_broadcast(none), "g", "left_semi"), "g", "k", "v", s.eps, samples, block_rows))
            some = written(open_.join(other.filter("label >= 0"), "k").select("g").distinct(), "some")
            settled(other, "agglomerative", some)
        # a cluster with too large a share: smaller distances, while they find more and leave a smaller share
        best = written(open_.select("g", "k").join(labels, "k"), "best")
        now = first
        for step in (0.04, 0.06, 0.08):
            wide = first.filter("ratio >= 0.35 AND rows >= 100").select("g")
            if not wide.take(1):
                break
            tried = of(density(open_.join(maybe_broadcast(wide), "g", "left_semi"), "g", "k", "v", max(0.18, s.eps - step), samples, block_rows))
            then = counted(tried).select("g", F.col("clusters").alias("clusters_2"), F.col("ratio").alias("ratio_2"))
            better = now.join(then, "g").filter("clusters_2 > 0 AND ratio_2 < ratio AND clusters_2 >= greatest(2, clusters)")
            better = written(better.select("g", "rows", F.col("clusters_2").alias("clusters"), F.col("ratio_2").alias("ratio")), "better")
            now = written(now.join(better, "g", "left_anti").unionByName(better), "now")
            new = best.join(maybe_broadcast(better.select("g")), "g", "left_semi").select("g", "k").join(tried, "k")
            best = written(best.join(maybe_broadcast(better.select("g")), "g", "left_anti").unionByName(new.select("g", "k", "label")), "best")
        settled(best.select("k", "label"), "dbscan", None)
    return reduce(DataFrame.unionByName, done)
