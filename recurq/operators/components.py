"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per vertex, combined on the map side, and a join back on the vertex; a hot vertex is
met by broadcast. Edges and labels stay in tables in the shared folder; only two counts reach the driver in each
round. The rounds end when the edges are stars: no vertex lies between two others and no vertex hangs on two, so every
vertex hangs on the least it can reach and is in the result once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurq.sources.shared import drop_path, new_path


#: A vertex with more than 1 / ``HOT_VERTICES`` of the rows, and at least ``HOT_ROWS``, is hot: at most that many are.
HOT_VERTICES, HOT_ROWS = 10_000, 100


def _with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of their ``u``. Hot vertices' come by broadcast, so no task gets all rows of one."""
    limit = max(HOT_ROWS, n_rows // HOT_VERTICES)
    if n_rows <= limit:
        return rows.join(least.drop("n").hint("merge"), "u")
    hot, others = F.broadcast(least.filter(F.col("n") > limit).drop("n")), least.filter(F.col("n") <= limit).drop("n")
    return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(others.hint("merge"), "u"))


def _star(edges: DataFrame, large: bool, n_rows: int) -> DataFrame:
    """One step over ``n_rows`` (u, v) rows with u > v. Large: each vertex hangs its larger neighbours on its smallest."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        return _with_least(both.filter("v > u"), least, 2 * n_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = _with_least(edges, least, n_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, component) of every vertex that has an edge to another; component is the least vertex reachable.

    Loops and repeated edges have no effect; without edges the result is empty.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        down = df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down.write.parquet(path)
        return spark.read.schema(down.schema).parquet(path), path

    def ends(table: DataFrame) -> tuple[int, int]:
        """How many edges there are, and how many vertices are the larger end of two, or of one while they are the least end of another."""
        both = table.select(F.col("u").alias("x"), F.lit(1).alias("larger")).unionAll(table.select("v", F.lit(0)))
        of = both.groupBy("x").agg(F.sum("larger").alias("n"), F.min("larger").alias("least"))
        row = of.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.expr("CASE WHEN n > 1 OR n > 0 AND least = 0 THEN 1 END"))).first()
        return row[0], row[1]

    table, path = state(edges.select(F.col(u).alias("u"), F.col(v).alias("v")))
    n_edges, unsettled = ends(table)
    while unsettled:  # else the edges are stars and no further round can change them
        after_large, large_path = state(_star(table, True, n_edges))
        after, next_path = state(_star(after_large, False, after_large.count()))
        drop_path(spark, large_path)
        drop_path(spark, path)
        table, path = after, next_path
        n_edges, unsettled = ends(table)
    roots = table.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(roots)
